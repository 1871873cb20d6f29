"""Go, with type parameters. Semicolons are put in at line ends, as the language does."""

from __future__ import annotations

import re

from codeloom.llm.syntax.lexing import END, ID, NUM, STR, WORD, Alphabet, Bad, Parser, Tokens, word_coder

_RESERVED = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_OPS = "... := <- == != <= >= && || ++ -- << >> &^ += -= *= /= %= <<= >>= &= |= ^= &^="
A = Alphabet(_RESERVED, _OPS)
K = A.of
BINARY = A.set("== != <= >= && || << >> &^ + - * / % & | ^ < >")
ASSIGN = A.set("= := += -= *= /= %= <<= >>= &= |= ^= &^=")
UNARY = A.set("! ~ + - * & ^ <-")
_LITERAL = re.compile(r"""(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)|(?P<s>`[^`]*+`|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\(?:x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}|[0-7]{3}|.))')""")
_NUMBER = re.compile(r"(?:0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?|0[oO]?[0-7_]+|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?")
_ALLOWED = re.compile("[ins(){}\\[\\];,.<>=+\\-*/%&|^!~:\ue000-\uf8ff]*")
_ENDS = frozenset({ID, NUM, STR, ")", "]", "}"}) | A.set("break continue fallthrough return ++ --")


_word = word_coder(A.words, _NUMBER)


def tokens(text: str) -> Tokens:
    code = _LITERAL.sub(lambda m: "\x01" if m["c"] is None else "\n" if "\n" in m["c"] else " ", text.lstrip("\ufeff"))
    if "'" in code or '"' in code or "`" in code or "/*" in code:
        raise Bad("literal without end")
    code = A.op_pattern.sub(lambda m: A.ops[m[0]], WORD.sub(_word, code)).replace("\x01", STR)
    lines = ["".join(x.split()) for x in code.split("\n")]
    out = Tokens([x + ";" if x and x[-1] in _ENDS else x for x in lines])
    if not _ALLOWED.fullmatch(out.s[:-1]):
        raise Bad("character")
    return out


class Go(Parser):
    memo: dict = {}
    #: In the header of if, for and switch a `{` after a name opens the block, not a literal.
    header = False

    def unit(self) -> None:
        s = self.s
        self.need(K["package"])
        self.need(ID)
        self.end()
        while self.take(K["import"]):
            self.group(self.import_spec)
            self.end()
        while s[self.p] != END:
            c = s[self.p]
            if c == K["func"]:
                self.function()
            elif c in _DECLARES:
                self.declaration()
            else:
                self.fail("no declaration")
            self.end()

    def end(self) -> None:
        c = self.s[self.p]
        if c == ";":
            self.p += 1
        elif c not in ")}\0":
            self.fail("statement does not end")

    def group(self, rule) -> None:
        if self.take("("):
            while not self.take(")"):
                rule()
                self.end()
        else:
            rule()

    def import_spec(self) -> None:
        if self.s[self.p] in (ID, "."):
            self.p += 1
        self.need(STR)

    def names(self) -> None:
        self.need(ID)
        while self.take(","):
            self.need(ID)

    def declaration(self) -> None:
        c = self.s[self.p]
        self.p += 1
        self.group(self.type_spec if c == K["type"] else self.const_spec if c == K["const"] else self.var_spec)

    def const_spec(self) -> None:
        self.names()
        if self.s[self.p] not in "=;)":
            self.type()
        if self.take("="):
            self.expressions()

    def var_spec(self) -> None:
        self.names()
        if self.s[self.p] != "=":
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.need(ID)
        if self.s[self.p] == "[" and not self.attempt(self.type_parameters):
            pass
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.names()
            self.constraint()
            if self.s[self.p] != "]":
                self.need(",")

    def constraint(self) -> None:
        self.take("~")
        self.type()
        while self.take("|"):
            self.take("~")
            self.type()

    def function(self) -> None:
        self.p += 1
        if self.s[self.p] == "(":
            self.parameters()
        self.need(ID)
        if self.s[self.p] == "[":
            self.type_parameters()
        self.signature()
        if self.s[self.p] == "{":
            self.block()

    def signature(self) -> None:
        self.parameters()
        c = self.s[self.p]
        if c == "(":
            self.parameters()
        elif c in _TYPE_STARTS:
            self.type()

    def parameters(self) -> None:
        """Either all have names or none has."""
        at = self.p
        self.need("(")
        while not self.take(")"):
            self.names_or_type()
            if self.s[self.p] != ")":
                self.need(",")
        if self.p == at:
            self.fail()

    def names_or_type(self) -> None:
        s = self.s
        if s[self.p] == ID and (s[self.p + 1] in _TYPE_STARTS - {"(", "["} or s[self.p + 1] == K["..."]):
            self.p += 1
        elif s[self.p] == ID and s[self.p + 1] in "([":
            at = self.p
            self.p += 1
            if self.attempt(self.type) and s[self.p] in ",)":
                return
            self.p = at
        self.take(K["..."])
        self.type()

    def type(self) -> None:
        s, c = self.s, self.s[self.p]
        if c == ID:
            self.p += 1
            if s[self.p] == "." and s[self.p + 1] == ID:
                self.p += 2
            if s[self.p] == "[" and s[self.p + 1] != "]":
                self.attempt(self.type_arguments)
        elif c == "*":
            self.p += 1
            self.type()
        elif c == "(":
            self.p += 1
            self.type()
            self.need(")")
        elif c == "[":
            self.p += 1
            if not self.take("]"):
                if not self.take(K["..."]):
                    self.value()
                self.need("]")
            self.type()
        elif c == K["map"]:
            self.p += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif c == K["chan"]:
            self.p += 1
            self.take(K["<-"])
            self.type()
        elif c == K["<-"]:
            self.p += 1
            self.need(K["chan"])
            self.type()
        elif c == K["func"]:
            self.p += 1
            self.signature()
        elif c == K["struct"]:
            self.p += 1
            self.need("{")
            while not self.take("}"):
                if s[self.p] == "*" or s[self.p] == ID and s[self.p + 1] in ".;}" + STR:
                    self.take("*")
                    self.type()
                else:
                    self.names()
                    self.type()
                self.take(STR)
                self.end()
        elif c == K["interface"]:
            self.p += 1
            self.need("{")
            while not self.take("}"):
                if s[self.p] == ID and s[self.p + 1] == "(":
                    self.p += 1
                    self.signature()
                else:
                    self.constraint()
                self.end()
        else:
            self.fail("no type")

    def type_arguments(self) -> None:
        self.need("[")
        while not self.take("]"):
            self.type()
            if self.s[self.p] != "]":
                self.need(",")

    # statements

    def block(self) -> None:
        self.need("{")
        outer, self.header = self.header, False
        self.statements("}")
        self.header = outer
        self.p += 1

    def statements(self, ends) -> None:
        s = self.s
        while s[self.p] not in ends:
            if self.p in self.first:
                stop = self.line_end()
                if s[stop - 1] == ";" and self.known(s[self.p : stop]):
                    self.p = stop
                    continue
            self.statement()
            self.end()

    def known(self, line: str) -> bool:
        found = self.memo.get(line)
        if found is None:
            found = False
            if not any(K[w] in line for w in ("if", "else", "case", "default")):
                try:
                    sub = Go(Tokens([line]))
                    while sub.s[sub.p] != END:
                        sub.statement()
                        sub.end()
                    found = True
                except Bad:
                    pass
            if len(self.memo) > self.MEMO_LIMIT:
                self.memo.clear()
            self.memo[line] = found
        return found

    def statement(self) -> None:
        s, c = self.s, self.s[self.p]
        rule = _STATEMENTS.get(c)
        if rule is not None:
            return rule(self)
        if c == ID and s[self.p + 1] == ":" and not self.header:
            self.p += 2
            if s[self.p] not in ";}":
                self.statement()
            return None
        if c in ";}":
            return None
        return self.simple()

    def simple(self) -> None:
        s = self.s
        if s[self.p] == K["range"]:
            self.p += 1
            return self.value()
        self.expressions()
        c = s[self.p]
        if c in ASSIGN:
            self.p += 1
            self.take(K["range"])
            self.expressions()
        elif c in (K["++"], K["--"]):
            self.p += 1
        elif c == K["<-"]:
            self.p += 1
            self.value()
        return None

    def header_of(self, rule) -> None:
        outer, self.header = self.header, True
        rule()
        self.header = outer

    def if_(self) -> None:
        self.p += 1
        self.header_of(self.if_header)
        self.block()
        if self.take(K["else"]):
            if self.s[self.p] == K["if"]:
                self.if_()
            else:
                self.block()

    def if_header(self) -> None:
        if self.s[self.p] != ";":
            self.simple()
        if self.take(";"):
            self.simple()

    def for_(self) -> None:
        self.p += 1
        if self.s[self.p] != "{":
            self.header_of(self.for_header)
        self.block()

    def for_header(self) -> None:
        s = self.s
        if s[self.p] != ";":
            self.simple()
        if s[self.p] != "{":
            self.need(";")
            if s[self.p] != ";":
                self.value()
            self.need(";")
            if s[self.p] != "{":
                self.simple()

    def switch(self) -> None:
        self.p += 1
        if self.s[self.p] != "{":
            self.header_of(self.switch_header)
        self.cases(self.expressions)

    def switch_header(self) -> None:
        if self.s[self.p] != ";":
            self.simple()
        if self.take(";") and self.s[self.p] != "{":
            self.simple()

    def cases(self, label) -> None:
        self.need("{")
        outer, self.header = self.header, False
        while not self.take("}"):
            if self.take(K["case"]):
                label()
            else:
                self.need(K["default"])
            self.need(":")
            self.statements(_CASE_ENDS)
        self.header = outer

    def select(self) -> None:
        self.p += 1
        self.cases(self.simple)

    def return_(self) -> None:
        self.p += 1
        if self.s[self.p] not in ";}":
            self.expressions()

    def jump(self) -> None:
        self.p += 1
        self.take(ID)

    def call(self) -> None:
        self.p += 1
        self.value()
        if self.s[self.p - 1] != ")":
            self.fail("no call")

    # expressions

    def expressions(self) -> None:
        self.value()
        while self.take(","):
            self.value()

    def value(self) -> None:
        self.unary()
        while self.s[self.p] in BINARY:
            self.p += 1
            self.unary()

    def unary(self) -> None:
        while self.s[self.p] in UNARY:
            if self.s[self.p] == K["<-"] and self.s[self.p + 1] == K["chan"]:
                break
            self.p += 1
        self.operand()

    def operand(self) -> None:
        s, c = self.s, self.s[self.p]
        composite = False
        if c == ID:
            self.p += 1
            composite = True
        elif c in (NUM, STR):
            self.p += 1
        elif c == "(":
            outer, self.header = self.header, False
            self.p += 1
            if not self.attempt(self.closed_value):
                self.type()
                self.need(")")
            self.header = outer
        elif c == K["func"]:
            self.p += 1
            self.signature()
            if s[self.p] == "{":
                self.block()
        elif c == "[" or c in (K["map"], K["struct"], K["chan"], K["interface"], K["<-"]):
            self.type()
            if s[self.p] == "{":
                self.literal()
        else:
            self.fail("no expression")
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if self.take("("):
                    if not self.take(K["type"]):
                        self.type()
                    self.need(")")
                    composite = False
                else:
                    self.need(ID)
            elif c == "(":
                self.arguments()
                composite = False
            elif c == "[":
                outer, self.header = self.header, False
                if not self.attempt(self.index):
                    self.type_arguments()
                self.header = outer
            elif c == "{" and composite and not self.header:
                self.literal()
                composite = False
            else:
                return

    def closed_value(self) -> None:
        self.value()
        self.need(")")

    def index(self) -> None:
        self.p += 1
        if self.s[self.p] != ":":
            self.value()
        for _ in range(2):
            if self.take(":") and self.s[self.p] not in ":]":
                self.value()
        self.need("]")

    def arguments(self) -> None:
        outer, self.header = self.header, False
        self.need("(")
        while not self.take(")"):
            c = self.s[self.p]
            if c in (K["chan"], K["map"], K["struct"], K["interface"], "[", "*"):
                if not (self.attempt(self.argument)):
                    self.type()
            else:
                self.value()
            self.take(K["..."])
            if self.s[self.p] != ")":
                self.need(",")
        self.header = outer

    def argument(self) -> None:
        self.value()
        if self.s[self.p] not in ",)" + K["..."]:
            self.fail("argument")

    def literal(self) -> None:
        outer, self.header = self.header, False
        self.need("{")
        while not self.take("}"):
            self.element()
            if self.take(":"):
                self.element()
            if self.s[self.p] != "}":
                self.need(",")
        self.header = outer

    def element(self) -> None:
        if self.s[self.p] == "{":
            self.literal()
        else:
            self.value()


_DECLARES = A.set("var const type")
_TYPE_STARTS = frozenset({ID, "*", "(", "["}) | A.set("map chan func struct interface <-")
_CASE_ENDS = A.set("case default }")
_STATEMENTS = {
    "{": Go.block,
    K["var"]: Go.declaration,
    K["const"]: Go.declaration,
    K["type"]: Go.declaration,
    K["if"]: Go.if_,
    K["for"]: Go.for_,
    K["switch"]: Go.switch,
    K["select"]: Go.select,
    K["return"]: Go.return_,
    K["break"]: Go.jump,
    K["continue"]: Go.jump,
    K["goto"]: Go.jump,
    K["fallthrough"]: Go.jump,
    K["defer"]: Go.call,
    K["go"]: Go.call,
}


#: A file begins with its package clause; texts of other languages end here, before they are cut into tokens.
_FIRST = re.compile(r"\ufeff*(?:\s+|//[^\n]*|/\*(?s:.*?)\*/)*+package\b")


def check_go(text: str) -> None:
    if not _FIRST.match(text):
        raise Bad("beginning")
    Go(tokens(text)).unit()
