"""Java, up to records, sealed types, switch expressions and text blocks."""

from __future__ import annotations

import re

from codeloom.llm.syntax.lexing import END, ID, NUM, STR, WORD, Alphabet, Bad, Parser, Tokens, word_coder

_RESERVED = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_SOFT = "record sealed non permits yield var when module open"
_OPS = "... -> :: == != <= && || ++ -- << += -= *= /= %= <<= &= |= ^="
A = Alphabet(f"{_RESERVED} {_SOFT}", _OPS)
K = A.of
SOFT = A.set(_SOFT)
NAMES = SOFT | {ID}
PRIMITIVE = A.set("boolean byte char double float int long short")
MODIFIERS = A.set("public protected private static abstract final native synchronized transient volatile strictfp default sealed")
BINARY = A.set("== != <= && || << + - * / % & | ^ < >")
ASSIGN = A.set("= += -= *= /= %= <<= &= |= ^=")
STEP = A.set("++ --")
UNARY = A.set("! ~ + -")
ATOMS = A.set("null true false") | {NUM, STR}
TYPES = A.set("class interface enum")
_LITERAL = re.compile(
    r"""(?P<c>//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/)
    |(?P<s>\"{3}[ \t\f]*\n(?:[^"\\]|\\.|"(?!""))*+\"{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\(?:u+[\da-fA-F]{4}|[0-7]{1,3}|.))')""",
    re.X | re.S,
)
_NUMBER = re.compile(r"0[xX][\da-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|\d[\d_]*[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[fFdD]?")
_ALLOWED = re.compile("[ins(){}\\[\\];,.<>=+\\-*/%&|^!~?:@\ue000-\uf8ff]*")


_word = word_coder(A.words, _NUMBER)


def tokens(text: str) -> Tokens:
    code = _LITERAL.sub(lambda m: "\x01" if m["c"] is None else "\n" if "\n" in m["c"] else " ", text.lstrip("\ufeff"))
    if "'" in code or '"' in code or "/*" in code:
        raise Bad("literal without end")
    code = A.op_pattern.sub(lambda m: A.ops[m[0]], WORD.sub(_word, code)).replace("\x01", STR)
    out = Tokens(["".join(x.split()) for x in code.splitlines()])
    if not _ALLOWED.fullmatch(out.s[:-1]):
        raise Bad("character")
    return out


class Java(Parser):
    memo: dict = {}

    def unit(self) -> None:
        s = self.s
        at = self.p
        self.modifiers()
        if not self.take(K["package"]):
            self.p = at
        else:
            self.qualified()
            self.need(";")
        while s[self.p] == K["import"]:
            self.p += 1
            self.take(K["static"])
            self.name()
            while self.take("."):
                if self.take("*"):
                    break
                self.name()
            self.need(";")
        while s[self.p] != END:
            if not self.take(";"):
                self.modifiers()
                self.type_declaration()

    def name(self) -> None:
        if self.s[self.p] not in NAMES:
            self.fail("no name")
        self.p += 1

    def qualified(self) -> None:
        self.name()
        while self.s[self.p] == "." and self.s[self.p + 1] in NAMES:
            self.p += 2

    def modifiers(self) -> None:
        s = self.s
        while True:
            c = s[self.p]
            if c == "@" and s[self.p + 1] != K["interface"]:
                self.annotation()
            elif c in MODIFIERS and not (c == K["default"] and s[self.p + 1] in ":" + K["->"]) and not (c == K["sealed"] and s[self.p + 1] in "(.=;,)"):
                if c == K["synchronized"] and s[self.p + 1] == "(":
                    return
                self.p += 1
            elif c == K["non"] and s[self.p + 1] == "-" and s[self.p + 2] == K["sealed"]:
                self.p += 3
            else:
                return

    def annotation(self) -> None:
        self.p += 1
        self.qualified()
        if self.take("("):
            while not self.take(")"):
                if self.s[self.p] in NAMES and self.s[self.p + 1] == "=":
                    self.p += 2
                self.element()
                if self.s[self.p] != ")":
                    self.need(",")

    def element(self) -> None:
        if self.s[self.p] == "@":
            self.annotation()
        elif self.s[self.p] == "{":
            self.array(self.element)
        else:
            self.expression()

    def array(self, rule) -> None:
        self.need("{")
        while not self.take("}"):
            rule()
            if self.s[self.p] != "}":
                self.need(",")

    def starts_type(self) -> bool:
        s, c = self.s, self.s[self.p]
        return c in TYPES or c == "@" and s[self.p + 1] == K["interface"] or c == K["record"] and s[self.p + 1] in NAMES and s[self.p + 2] in "(<"

    def type_declaration(self) -> None:
        c = self.s[self.p]
        if c == "@":
            self.p += 1
            c = self.s[self.p]
        if not self.starts_type():
            self.fail("no type declaration")
        self.p += 1
        self.name()
        self.type_parameters()
        if c == K["record"]:
            self.parameters()
        for word in ("extends", "implements", "permits"):
            if self.take(K[word]):
                self.type()
                while self.take(","):
                    self.type()
        if c == K["enum"]:
            self.enum_body()
        else:
            self.class_body()

    def enum_body(self) -> None:
        self.need("{")
        while self.s[self.p] in NAMES or self.s[self.p] == "@":
            self.modifiers()
            self.name()
            if self.s[self.p] == "(":
                self.arguments()
            if self.s[self.p] == "{":
                self.class_body()
            if not self.take(","):
                break
        if self.take(";"):
            self.members()
        self.need("}")

    def class_body(self) -> None:
        self.need("{")
        self.members()
        self.need("}")

    def members(self) -> None:
        s = self.s
        while s[self.p] != "}":
            if s[self.p] == END:
                self.fail("class without end")
            if self.take(";"):
                continue
            if s[self.p] == "{" or s[self.p] == K["static"] and s[self.p + 1] == "{":
                self.take(K["static"])
                self.block()
                continue
            self.modifiers()
            if self.starts_type():
                self.type_declaration()
                continue
            self.type_parameters()
            if s[self.p] in NAMES and s[self.p + 1] in "({":  # constructor
                self.p += 1
                if s[self.p] == "(":
                    self.parameters()
                self.throws()
                self.block()
                continue
            if not self.take(K["void"]):
                self.type()
            self.name()
            if s[self.p] == "(":
                self.parameters()
                self.dims()
                self.throws()
                if self.take(K["default"]):
                    self.element()
                if s[self.p] == "{":
                    self.block()
                else:
                    self.need(";")
            else:
                self.declarators()
                self.need(";")

    def throws(self) -> None:
        if self.take(K["throws"]):
            self.type()
            while self.take(","):
                self.type()

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dims()
            if self.take("="):
                self.initialiser()
            if not self.take(","):
                return
            self.name()

    def initialiser(self) -> None:
        if self.s[self.p] == "{":
            self.array(self.initialiser)
        else:
            self.expression()

    def dims(self) -> None:
        while self.s[self.p] == "[" and self.s[self.p + 1] == "]":
            self.p += 2

    def parameters(self) -> None:
        self.need("(")
        while not self.take(")"):
            self.modifiers()
            self.type()
            self.take(K["..."])
            if self.s[self.p] == K["this"]:
                self.p += 1
            else:
                self.name()
            self.dims()
            if self.s[self.p] != ")":
                self.need(",")
                if self.s[self.p] == ")":
                    self.fail("parameter")

    def type_parameters(self) -> None:
        if self.s[self.p] != "<":
            return
        self.p += 1
        while True:
            self.modifiers()
            self.name()
            if self.take(K["extends"]):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    def type(self) -> None:
        s = self.s
        while s[self.p] == "@":
            self.annotation()
        if s[self.p] in PRIMITIVE:
            self.p += 1
        else:
            self.name()
            self.type_arguments()
            while s[self.p] == "." and s[self.p + 1] in NAMES:
                self.p += 2
                self.type_arguments()
        self.dims()

    def type_arguments(self) -> None:
        if not self.take("<"):
            return
        if self.take(">"):
            return
        while True:
            while self.s[self.p] == "@":
                self.annotation()
            if self.take("?"):
                if self.s[self.p] in (K["extends"], K["super"]):
                    self.p += 1
                    self.type()
            else:
                self.type()
            if not self.take(","):
                break
        self.need(">")

    # statements

    def block(self) -> None:
        s = self.s
        self.need("{")
        while s[self.p] != "}":
            if self.p in self.first:
                stop = self.line_end()
                if s[stop - 1] == ";" and self.known(s[self.p : stop]):
                    self.p = stop
                    continue
            self.statement()
        self.p += 1

    def known(self, line: str) -> bool:
        found = self.memo.get(line)
        if found is None:
            found = False
            if not any(K[w] in line for w in ("if", "else", "do", "try", "case", "default")):
                try:
                    sub = Java(Tokens([line]))
                    while sub.s[sub.p] != END:
                        sub.statement()
                    found = True
                except Bad:
                    pass
            if len(self.memo) > self.MEMO_LIMIT:
                self.memo.clear()
            self.memo[line] = found
        return found

    def local(self) -> None:
        self.type()
        self.name()
        if self.s[self.p] not in "=,;:[":
            self.fail("declaration")

    def statement(self) -> None:
        s, c = self.s, self.s[self.p]
        rule = _STATEMENTS.get(c)
        if rule is not None:
            return rule(self)
        if c == K["yield"] and s[self.p + 1] not in "=.([" and s[self.p + 1] not in STEP:
            self.p += 1
            self.expression()
            return self.need(";")
        if c in NAMES and s[self.p + 1] == ":":
            self.p += 2
            return self.statement()
        if c == "@" or c in (K["final"], K["abstract"], K["static"], K["sealed"]) or self.starts_type():
            self.modifiers()
            if self.starts_type():
                return self.type_declaration()
            self.local()
            self.declarators()
            return self.need(";")
        if (c in PRIMITIVE or c in NAMES and s[self.p + 1] in _MAY_DECLARE) and self.attempt(self.local):
            self.declarators()
            return self.need(";")
        self.expression_statement()
        return self.need(";")

    def expression_statement(self) -> None:
        """Only assignments, steps, calls and creations stand alone."""
        self.shape = ""
        self.expression()
        if self.shape not in ("call", "new", "assign", "step"):
            self.fail("not a statement")

    def parens(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def if_(self) -> None:
        self.p += 1
        self.parens()
        self.statement()
        if self.take(K["else"]):
            self.statement()

    def for_(self) -> None:
        s = self.s
        self.p += 1
        self.need("(")
        if s[self.p] != ";":
            self.modifiers()
            if self.attempt(self.local):
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.expression_statement()
                while self.take(","):
                    self.expression_statement()
        self.need(";")
        if s[self.p] != ";":
            self.expression()
        self.need(";")
        if s[self.p] != ")":
            self.expression_statement()
            while self.take(","):
                self.expression_statement()
        self.need(")")
        return self.statement()

    def while_(self) -> None:
        self.p += 1
        self.parens()
        self.statement()

    def do_(self) -> None:
        self.p += 1
        self.statement()
        self.need(K["while"])
        self.parens()
        self.need(";")

    def try_(self) -> None:
        s = self.s
        self.p += 1
        ok = False
        if self.take("("):
            ok = True
            while not self.take(")"):
                self.modifiers()
                if self.attempt(self.local):
                    self.need("=")
                self.expression()
                if s[self.p] != ")":
                    self.need(";")
        self.block()
        while self.take(K["catch"]):
            ok = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.take(K["finally"]):
            ok = True
            self.block()
        if not ok:
            self.fail("try alone")

    def switch(self) -> None:
        s = self.s
        self.p += 1
        self.parens()
        self.need("{")
        while not self.take("}"):
            if self.take(K["default"]):
                pass
            else:
                self.need(K["case"])
                while True:
                    self.label()
                    if not self.take(","):
                        break
                if self.take(K["when"]):
                    self.expression()
            if self.take(K["->"]):
                if s[self.p] == "{":
                    self.block()
                elif s[self.p] == K["throw"]:
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while s[self.p] not in _CASE_ENDS:
                    self.statement()

    def label(self) -> None:
        if self.take(K["default"]):
            return
        if not self.attempt(self.pattern):
            self.ternary()

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            while not self.take(")"):
                self.pattern()
                if self.s[self.p] != ")":
                    self.need(",")
            if self.s[self.p] in NAMES and self.s[self.p] != K["when"]:
                self.p += 1
        else:
            self.name()

    def jump(self) -> None:
        self.p += 1
        if self.s[self.p] in NAMES:
            self.p += 1
        self.need(";")

    def return_(self) -> None:
        self.p += 1
        if self.s[self.p] != ";":
            self.expression()
        self.need(";")

    def throw(self) -> None:
        self.p += 1
        self.expression()
        self.need(";")

    def assert_(self) -> None:
        self.p += 1
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def synchronized(self) -> None:
        self.p += 1
        self.parens()
        self.block()

    def empty(self) -> None:
        self.p += 1

    # expressions

    def expression(self) -> None:
        s, c = self.s, self.s[self.p]
        if c in NAMES and s[self.p + 1] == K["->"]:
            self.p += 1
            return self.lambda_body()
        if c == "(" and s[self.closing[self.p] + 1] == K["->"]:
            if not self.attempt(self.parameters):
                self.need("(")
                while not self.take(")"):
                    self.name()
                    if s[self.p] != ")":
                        self.need(",")
            return self.lambda_body()
        self.ternary()
        if s[self.p] in ASSIGN:
            if self.shape != "place":
                self.fail("not assignable")
            self.p += 1
            self.expression()
            self.shape = "assign"
        return None

    def lambda_body(self) -> None:
        self.need(K["->"])
        if self.s[self.p] == "{":
            self.block()
        else:
            self.expression()
        self.shape = "lambda"

    def ternary(self) -> None:
        s = self.s
        self.unary()
        while True:
            c = s[self.p]
            if c in BINARY:
                self.p += 1
                if c == ">":
                    at = self.p
                    while s[self.p] == ">":
                        self.p += 1
                    if self.take("=") and self.p - at > 1:
                        self.expression()
                        self.shape = "assign"
                        return
                self.unary()
                self.shape = "value"
            elif c == K["instanceof"]:
                self.p += 1
                if not self.attempt(self.pattern):
                    self.take(K["final"])
                    self.type()
                self.shape = "value"
            else:
                break
        if c == "?":
            self.p += 1
            self.expression()
            self.need(":")
            if s[self.p] in NAMES and s[self.p + 1] == K["->"] or s[self.p] == "(" and s[self.closing[self.p] + 1] == K["->"]:
                self.expression()
            else:
                self.ternary()
            self.shape = "value"

    def unary(self) -> None:
        s, c = self.s, self.s[self.p]
        if c in STEP:
            self.p += 1
            self.unary()
            if self.shape != "place":
                self.fail("step")
            self.shape = "step"
            return
        if c in UNARY:
            self.p += 1
            self.unary()
            self.shape = "value"
            return
        if c == "(" and self.attempt(self.cast):
            self.shape = "value"
            return
        self.primary()
        if s[self.p] in STEP:
            if self.shape != "place":
                self.fail("step")
            self.p += 1
            self.shape = "step"

    def cast(self) -> None:
        s = self.s
        primitive = s[self.p + 1] in PRIMITIVE
        self.p += 1
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        c = s[self.p]
        if not (primitive or c in NAMES or c in ATOMS or c in "(!~@" or c in _CAST_NEXT):
            self.fail("cast")
        if c in NAMES and s[self.p + 1] == K["->"] or c == "(" and s[self.closing[self.p] + 1] == K["->"]:
            self.expression()
        else:
            self.unary()

    def primary(self) -> None:
        s, c = self.s, self.s[self.p]
        if c == ID:
            self.p += 1
            self.shape = "place"
        elif c in ATOMS or c == K["this"]:
            self.p += 1
            self.shape = "value"
            if s[self.p] == "(" and c == K["this"]:
                self.arguments()
                self.shape = "call"
        elif c == K["super"]:
            self.p += 1
            if s[self.p] == "(":
                self.arguments()
                self.shape = "call"
            elif s[self.p] not in "." + K["::"]:
                self.fail("super")
        elif c == "(":
            self.p += 1
            self.expression()
            self.need(")")
            if self.shape != "place":
                self.shape = "value"
        elif c == K["new"]:
            self.creation()
        elif c == K["switch"]:
            self.switch()
            self.shape = "value"
        elif c in PRIMITIVE or c == K["void"]:
            self.p += 1
            self.dims()
            if self.take("."):
                self.need(K["class"])
            else:
                self.need(K["::"])
                self.need(K["new"])
            self.shape = "value"
        elif c in SOFT:
            self.p += 1
            self.shape = "place"
        else:
            self.fail("no expression")
        while True:
            c = s[self.p]
            if c == ".":
                self.p += 1
                if self.take(K["new"]):
                    self.p -= 1
                    self.creation()
                elif s[self.p] in (K["class"], K["this"]):
                    self.p += 1
                    self.shape = "value"
                elif self.take(K["super"]):
                    self.shape = "value"
                    if s[self.p] == "(":
                        self.arguments()
                        self.shape = "call"
                else:
                    if s[self.p] == "<":
                        self.type_arguments()
                    self.name()
                    self.shape = "place"
            elif c == "(" and self.shape == "place" and s[self.p - 1] in NAMES:
                self.arguments()
                self.shape = "call"
            elif c == "[":
                if s[self.p + 1] == "]":
                    self.dims()
                    if self.take("."):
                        self.need(K["class"])
                    elif s[self.p] != K["::"]:
                        self.fail("array type")
                    self.shape = "value"
                else:
                    self.p += 1
                    self.expression()
                    self.need("]")
                    self.shape = "place"
            elif c == K["::"]:
                self.p += 1
                if s[self.p] == "<":
                    self.type_arguments()
                if not self.take(K["new"]):
                    self.name()
                self.shape = "value"
            elif c == "<" and self.shape == "place" and self.attempt(self.generic_reference):
                self.shape = "value"
            else:
                return

    def generic_reference(self) -> None:
        self.type_arguments()
        self.dims()
        if self.s[self.p] != K["::"]:
            self.fail("type arguments")

    def creation(self) -> None:
        s = self.s
        self.p += 1
        if s[self.p] == "<":
            self.type_arguments()
        while s[self.p] == "@":
            self.annotation()
        if s[self.p] in PRIMITIVE:
            self.p += 1
        else:
            self.name()
            self.type_arguments()
            while self.take("."):
                self.name()
                self.type_arguments()
        if s[self.p] == "[":
            while s[self.p] == "[":
                self.p += 1
                if not self.take("]"):
                    self.expression()
                    self.need("]")
            if s[self.p] == "{":
                self.array(self.initialiser)
            self.shape = "value"
            return
        self.arguments()
        if s[self.p] == "{":
            self.class_body()
        self.shape = "new"

    def arguments(self) -> None:
        self.need("(")
        if self.take(")"):
            return
        while True:
            self.expression()
            if not self.take(","):
                break
        self.need(")")


Java.shape = ""
_CASE_ENDS = A.set("case default }")
_MAY_DECLARE = NAMES | {"<", "[", ".", "@"}
_CAST_NEXT = PRIMITIVE | A.set("this super new switch")
_STATEMENTS = {
    "{": Java.block,
    ";": Java.empty,
    K["if"]: Java.if_,
    K["for"]: Java.for_,
    K["while"]: Java.while_,
    K["do"]: Java.do_,
    K["try"]: Java.try_,
    K["switch"]: Java.switch,
    K["break"]: Java.jump,
    K["continue"]: Java.jump,
    K["return"]: Java.return_,
    K["throw"]: Java.throw,
    K["assert"]: Java.assert_,
    K["synchronized"]: Java.synchronized,
}


#: What a compilation unit can begin with; most texts of other languages end here, before they are cut into tokens.
_FIRST = re.compile(
    r"\ufeff*(?:\s+|//[^\n]*|/\*(?s:.*?)\*/)*+(?:package\b|import\s+(?:static\s+)?\w+(?:\s*\.\s*[\w*]+)*\s*;|(?:class|interface|enum|record|public|protected|private|static|final|abstract|strictfp|sealed|non-sealed|default|native|synchronized|transient|volatile)\b|[@;]|\Z)"
)


def check_java(text: str) -> None:
    if not _FIRST.match(text):
        raise Bad("beginning")
    Java(tokens(text)).unit()
