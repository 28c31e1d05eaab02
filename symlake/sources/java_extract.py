"""Symbols of one Java source text: a tokenizer, a recursive-descent parser and a walk that emits rows.

Pure Python without Spark, so that it runs inside tasks. No bindings are resolved: type names are looked up in the
file's imports, then in its star imports (one candidate each), then in its package.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))'
    r'|(?P<text>"""[ \t\f]*\n(?:\\.|(?!""").)*(?:"""|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])*\'?)'
    r"|(?P<num>(?:0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?|\.?[0-9](?:[eE][+-]|[0-9a-zA-Z_.])*))"
    r"|(?P<id>[^\W\d][\w$]*|\$[\w$]*)"
    r"|(?P<op>>>>=|<<=|>>=|\.\.\.|->|::|\+\+|--|&&|\|\||[=!<>+\-*/&|^%]=|<<|.)",
    re.S,
)
PRIMITIVES = {"boolean", "byte", "char", "short", "int", "long", "float", "double", "void"}
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
KEYWORDS = {"abstract", "assert", "break", "case", "catch", "class", "const", "continue", "do", "else", "enum", "extends", "finally", "for", "goto", "if", "implements", "import", "instanceof", "interface", "new", "package", "return", "super", "switch", "this", "throw", "throws", "try", "while", "null", "true", "false"} | PRIMITIVES | (MODIFIERS - {"sealed", "default"}) | {"default"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", ">>>="}
BINARY = {"+", "-", "*", "/", "%", "&", "|", "^", "&&", "||", "==", "!=", "<=", ">=", "<<"}


class Row(NamedTuple):
    qualified_name: str
    name: str
    kind: str
    location: str
    package_name: str
    line: int
    start_char: int
    end_line: int
    end_char: int
    annotations: list[dict[str, Any]]


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int


class Node:
    """A syntax node: kind, span, the text it is printed as, children in the order of a visit, and extras."""

    __slots__ = ("kind", "start", "end", "text", "kids", "extra")

    def __init__(self, kind: str, start: int, end: int, text: str = "", kids: list[Node] | None = None, **extra: Any) -> None:
        self.kind, self.start, self.end, self.text, self.kids, self.extra = kind, start, end, text, kids or [], extra


class SyntaxTrouble(Exception):
    pass


def tokenize(source: str) -> list[Token]:
    out = []
    for m in TOKEN.finditer(source):
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m.group(), m.start(), m.end()))
    return out


class Parser:
    def __init__(self, source: str) -> None:
        self.t = tokenize(source)
        self.t.append(Token("end", "", len(source), len(source)))
        self.i = 0
        self.errors: list[str] = []

    # Tokens -----------------------------------------------------------------------------------------------

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def peek(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def at(self, *texts: str) -> bool:
        tok = self.t[self.i]
        return tok.text in texts and tok.kind != "text"

    def take(self) -> Token:
        tok = self.t[self.i]
        if tok.kind != "end":
            self.i += 1
        return tok

    def accept(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def expect(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxTrouble(f"expected {text!r}, found {self.now.text!r} at {self.now.start}")
        return self.take()

    def name(self) -> Token:
        if self.now.kind != "id" or self.now.text in KEYWORDS:
            raise SyntaxTrouble(f"expected a name, found {self.now.text!r} at {self.now.start}")
        return self.take()

    def last_end(self) -> int:
        return self.t[self.i - 1].end if self.i else 0

    def tentative(self, f: Callable[[], Any]) -> Any:
        """The result of f, or None with nothing consumed."""
        start, errors = self.i, len(self.errors)
        try:
            found = f()
        except SyntaxTrouble:
            found = None
        if found is None:
            self.i = start
            del self.errors[errors:]
        return found

    def qualified(self) -> Node:
        start = self.name()
        text = start.text
        while self.at(".") and self.peek().kind == "id" and self.peek().text not in KEYWORDS:
            self.take()
            text += "." + self.name().text
        return Node("name", start.start, self.last_end(), text)

    # Types ------------------------------------------------------------------------------------------------

    def type_arguments(self) -> tuple[str, list[Node]]:
        self.expect("<")
        texts, kids = [], []
        while not self.at(">"):
            kids += self.annotations()
            if self.accept("?"):
                text = "?"
                if self.at("extends", "super"):
                    text += f" {self.take().text} "
                    t = self.type()
                    text += t.text
                    kids += t.kids
            else:
                t = self.type()
                text = t.text
                kids += t.kids
            texts.append(text)
            if not self.accept(","):
                break
        self.expect(">")
        return "<" + ",".join(texts) + ">", kids

    def type(self, arrays: bool = True) -> Node:
        kids = self.annotations()
        start = self.now.start
        if self.now.text in PRIMITIVES and self.now.kind == "id":
            text = self.take().text
        else:
            text = self.name().text
            while True:
                if self.at("<"):
                    more, inner = self.type_arguments()
                    text += more
                    kids += inner
                if self.at(".") and (self.peek().kind == "id" and self.peek().text not in KEYWORDS or self.peek().text == "@"):
                    self.take()
                    kids += self.annotations()
                    text += "." + self.name().text
                else:
                    break
        if arrays:
            while self.at("[") and self.peek().text == "]" or self.at("@") and self.peek().text != "interface":
                if self.at("@"):
                    kids += self.annotations()
                else:
                    self.i += 2
                    text += "[]"
        return Node("type", start, self.last_end(), text, kids)

    def type_parameters(self) -> list[str]:
        names = []
        if self.accept("<"):
            while not self.at(">"):
                self.annotations()
                names.append(self.name().text)
                if self.accept("extends"):
                    self.type()
                    while self.accept("&"):
                        self.type()
                if not self.accept(","):
                    break
            self.expect(">")
        return names

    # Annotations and modifiers ----------------------------------------------------------------------------

    def annotations(self) -> list[Node]:
        out = []
        while self.at("@") and self.peek().text != "interface":
            out.append(self.annotation())
        return out

    def annotation(self) -> Node:
        start = self.expect("@").start
        name = self.qualified()
        elements: list[tuple[str, Node]] = []
        if self.accept("("):
            if self.now.kind == "id" and self.peek().text == "=":
                while not self.at(")"):
                    key = self.name().text
                    self.expect("=")
                    elements.append((key, self.element_value()))
                    if not self.accept(","):
                        break
            elif not self.at(")"):
                elements.append(("value", self.element_value()))
            self.expect(")")
        text = f"@{name.text}" + (f"({','.join(f'{k}={v.text}' for k, v in elements)})" if elements else "")
        return Node("annotation", start, self.last_end(), text, [v for _, v in elements], name=name.text, elements=elements)

    def element_value(self) -> Node:
        if self.at("@"):
            return self.annotation()
        if self.at("{"):
            return self.array_initializer()
        return self.ternary()

    def modifiers(self) -> list[Node]:
        """Annotations among modifiers; the other modifiers are passed over."""
        out = []
        while True:
            if self.at("@") and self.peek().text != "interface":
                out.append(self.annotation())
            elif self.now.kind == "id" and self.now.text in MODIFIERS and not (self.at("default") and self.peek().text in (":", "->")) and not (self.at("sealed") and self.peek().text in ("=", ".", ";")):
                self.take()
            elif self.at("non") and self.peek().text == "-" and self.peek(2).text == "sealed":
                self.i += 3
            else:
                return out

    # Declarations -----------------------------------------------------------------------------------------

    def unit(self) -> Node:
        kids: list[Node] = []
        while self.now.kind != "end":
            start = self.i
            try:
                kids += self.top()
            except (SyntaxTrouble, RecursionError) as e:
                self.recover(start, e)
        return Node("unit", 0, self.now.end, kids=kids)

    def recover(self, start: int, error: Exception) -> None:
        self.errors.append(str(error) or type(error).__name__)
        self.i = max(self.i, start + 1) if self.i == start else self.i
        depth = 0
        while self.now.kind != "end":
            if self.at("{"):
                depth += 1
            elif self.at("}"):
                if depth == 0:
                    return
                depth -= 1
                if depth == 0:
                    self.take()
                    return
            elif self.at(";") and depth == 0:
                self.take()
                return
            self.take()

    def top(self) -> list[Node]:
        if self.accept(";"):
            return []
        if self.at("}"):
            raise SyntaxTrouble(f"unexpected }} at {self.now.start}") if self.take() else None
        mods = self.modifiers()
        if self.at("package"):
            self.take()
            name = self.qualified()
            self.expect(";")
            return [Node("package", name.start, name.end, name.text)]
        if self.at("import"):
            start = self.take().start
            self.accept("static")
            name, star = self.qualified(), False
            if self.at(".") and self.peek().text == "*":
                self.i += 2
                star = True
            self.expect(";")
            return [Node("import", start, self.last_end(), name.text, star=star)]
        found = self.type_declaration(mods)
        if found is None:
            raise SyntaxTrouble(f"unexpected {self.now.text!r} at {self.now.start}")
        return [found]

    def type_declaration(self, mods: list[Node]) -> Node | None:
        if self.at("class", "interface"):
            return self.class_like(mods)
        if self.at("enum"):
            return self.enum(mods)
        if self.at("@") and self.peek().text == "interface":
            self.i += 2
            name = self.name()
            return Node("annotation_type", name.start, name.end, name.text, [*mods, *self.body(name.text)])
        if self.at("record") and self.peek().kind == "id" and self.peek(2).text in ("(", "<"):
            self.take()
            name = self.name()
            self.type_parameters()
            params = self.parameters()
            if self.accept("implements"):
                self.types()
            return Node("record", name.start, name.end, name.text, [*mods, *[a for p in params for a in p.kids], *self.body(name.text)])
        return None

    def types(self) -> list[Node]:
        out = [self.type()]
        while self.accept(","):
            out.append(self.type())
        return out

    def class_like(self, mods: list[Node]) -> Node:
        interface = self.take().text == "interface"
        name = self.name()
        self.type_parameters()
        superclass, interfaces = None, []
        while self.at("extends", "implements", "permits"):
            word = self.take().text
            found = self.types()
            if word == "extends" and not interface:
                superclass = found[0]
            elif word != "permits":
                interfaces += found
        return Node("class", name.start, name.end, name.text, [*mods, *self.body(name.text)], annotations=mods, interface=interface, superclass=superclass, interfaces=interfaces)

    def enum(self, mods: list[Node]) -> Node:
        self.take()
        name = self.name()
        interfaces = self.types() if self.accept("implements") else []
        self.expect("{")
        kids: list[Node] = []
        while not self.at(";", "}"):
            marks = self.modifiers()
            own = self.name()
            inner = list(marks)
            if self.at("("):
                inner += self.arguments()
            if self.at("{"):
                inner.append(Node("anonymous", self.now.start, self.now.end, kids=self.body("")))
            kids.append(Node("member", own.start, own.end, own.text, inner, annotations=marks))
            if not self.accept(","):
                break
        self.accept(";")
        kids += self.members(name.text)
        return Node("enum", name.start, name.end, name.text, [*mods, *kids], annotations=mods, interfaces=interfaces)

    def body(self, owner: str) -> list[Node]:
        self.expect("{")
        return self.members(owner)

    def members(self, owner: str) -> list[Node]:
        out: list[Node] = []
        while not self.at("}") and self.now.kind != "end":
            start = self.i
            try:
                out += self.member(owner)
            except (SyntaxTrouble, RecursionError) as e:
                self.recover(start, e)
        self.accept("}")
        return out

    def member(self, owner: str) -> list[Node]:
        if self.accept(";"):
            return []
        start = self.now.start
        mods = self.modifiers()
        if self.at("{"):
            return [Node("initializer", start, start, kids=[*mods, *self.block()])]
        nested = self.type_declaration(mods)
        if nested is not None:
            return [nested]
        params = self.type_parameters()
        marks = self.annotations()
        mods += marks
        if self.now.text == owner and self.peek().text in ("(", "{"):  # a constructor, maybe the compact one of a record
            name = self.take()
            args = self.parameters() if self.at("(") else []
            return [self.method(name, mods, params, None, args)]
        kind = self.type()
        name = self.name()
        if self.at("("):
            return [self.method(name, mods, params, kind, self.parameters())]
        fragments = self.fragments(name)
        self.expect(";")
        return [Node("field", start, self.last_end(), kids=[*mods, *kind.kids, *[k for f in fragments for k in f.kids]], annotations=mods, type=kind, fragments=fragments)]

    def method(self, name: Token, mods: list[Node], params: list[str], kind: Node | None, args: list[Node]) -> Node:
        while self.at("["):
            self.i += 2
        thrown = self.types() if self.accept("throws") else []
        kids = [*mods, *(kind.kids if kind else []), *[k for a in args for k in a.kids]]
        node_kind = "method"
        if self.accept("default"):  # an element of an annotation type
            kids.append(self.element_value())
            self.expect(";")
        elif self.at("{"):
            kids += self.block()
        else:
            self.expect(";")
        return Node(node_kind, name.start, name.end, name.text, kids, annotations=mods, parameters=args, type_parameters=params, returns=kind, thrown=thrown)

    def parameters(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.at(")"):
            mods = self.modifiers()
            kind = self.type()
            mods += self.annotations()
            self.accept("...")
            if self.at("this"):
                self.take()
            else:
                name = self.now
                while self.at("this") or self.peek().text == ".":
                    self.i += 2
                name = self.take() if self.at("this") else self.name()
                while self.at("[") and self.peek().text == "]":
                    self.i += 2
                out.append(Node("parameter", name.start, name.end, name.text, mods, type=kind))
            if not self.accept(","):
                break
        self.expect(")")
        return out

    def fragments(self, first: Token) -> list[Node]:
        out, name = [], first
        while True:
            while self.at("[") and self.peek().text == "]":
                self.i += 2
            kids = []
            if self.accept("="):
                kids.append(self.array_initializer() if self.at("{") else self.expression())
            out.append(Node("fragment", name.start, name.end, name.text, kids))
            if not self.accept(","):
                return out
            name = self.name()

    # Statements -------------------------------------------------------------------------------------------

    def block(self) -> list[Node]:
        self.expect("{")
        out: list[Node] = []
        while not self.at("}") and self.now.kind != "end":
            start = self.i
            try:
                out += self.statement()
            except (SyntaxTrouble, RecursionError) as e:
                self.recover(start, e)
        self.accept("}")
        return out

    def parenthesized(self) -> list[Node]:
        self.expect("(")
        out = [self.expression()]
        self.expect(")")
        return out

    def declaration(self) -> Node | None:
        """A local variable declaration up to its end, if one starts here; the type must be followed by a name."""
        start = self.now.start
        mods = self.modifiers()
        if self.now.text in KEYWORDS and self.now.text not in PRIMITIVES:
            return None
        kind = self.type()
        name = self.name()
        if not self.at("=", ";", ",", "[", ":") or name.text == "instanceof":
            return None
        if self.at(":"):
            self.take()
            return Node("each", start, name.end, kids=[*mods, self.expression()])
        fragments = self.fragments(name)
        return Node("local", start, self.last_end(), kids=[*mods, *kind.kids, *[k for f in fragments for k in f.kids]], type=kind, fragments=fragments)

    def statement(self) -> list[Node]:
        tok = self.now
        if tok.kind != "id" or tok.text not in KEYWORDS | {"yield", "record", "sealed"}:
            if self.accept(";"):
                return []
            if self.at("{"):
                return self.block()
            if tok.kind == "id" and self.peek().text == ":" and self.peek(2).text != ":":
                self.i += 2
                return self.statement()
        word = tok.text if tok.kind == "id" else ""
        if word == "if":
            self.take()
            out = self.parenthesized() + self.statement()
            return out + self.statement() if self.accept("else") else out
        if word == "while":
            self.take()
            return self.parenthesized() + self.statement()
        if word == "do":
            self.take()
            out = self.statement()
            self.expect("while")
            out += self.parenthesized()
            self.expect(";")
            return out
        if word == "for":
            return self.for_statement()
        if word in ("return", "throw", "break", "continue") or word == "yield" and self.peek().text not in ("=", ".", "(", "++", "--", "["):
            self.take()
            out = [] if self.at(";") else [self.expression()]
            self.expect(";")
            return out
        if word == "try":
            return self.try_statement()
        if word == "switch":
            found = self.tentative(lambda: self.switch_statement())
            if found is not None:
                return found
        if word == "synchronized" and self.peek().text == "(":
            self.take()
            return self.parenthesized() + self.block()
        if word == "assert":
            self.take()
            out = [self.expression()]
            if self.accept(":"):
                out.append(self.expression())
            self.expect(";")
            return out
        start = self.i
        mods = self.modifiers()
        nested = self.type_declaration(mods)
        if nested is not None:
            nested.extra["local"] = True
            return [nested]
        self.i = start
        local = self.tentative(self.declaration)
        if local is not None and local.kind == "local" and self.accept(";"):
            return [local]
        self.i = start
        if word in ("this", "super") and self.peek().text == "(":
            self.take()
            out = self.arguments()
        else:
            out = [self.expression()]
        self.expect(";")
        return out

    def for_statement(self) -> list[Node]:
        self.take()
        self.expect("(")
        out: list[Node] = []
        if not self.at(";"):
            first = self.tentative(self.declaration)
            if first is None:
                out.append(self.expression())
                while self.accept(","):
                    out.append(self.expression())
            else:
                out += first.kids
        if self.accept(";"):
            if not self.at(";"):
                out.append(self.expression())
            self.expect(";")
            while not self.at(")"):
                out.append(self.expression())
                if not self.accept(","):
                    break
        self.expect(")")
        return out + self.statement()

    def try_statement(self) -> list[Node]:
        self.take()
        out: list[Node] = []
        if self.accept("("):
            while not self.at(")"):
                found = self.tentative(self.resource)
                out += found.kids if found else [self.expression()]
                if not self.accept(";"):
                    break
            self.expect(")")
        out += self.block()
        while self.accept("catch"):
            self.expect("(")
            out += self.modifiers()
            self.type()
            while self.accept("|"):
                self.type()
            self.name()
            self.expect(")")
            out += self.block()
        if self.accept("finally"):
            out += self.block()
        return out

    def resource(self) -> Node:
        mods = self.modifiers()
        self.type()
        name = self.name()
        self.expect("=")
        return Node("resource", name.start, name.end, kids=[*mods, self.expression()])

    def switch_statement(self) -> list[Node]:
        self.take()
        out = self.parenthesized()
        out += self.switch_body()
        if self.at(".", "?", *BINARY):
            raise SyntaxTrouble("a switch expression")
        return out

    def switch_body(self) -> list[Node]:
        self.expect("{")
        out: list[Node] = []
        while not self.at("}") and self.now.kind != "end":
            if self.at("case", "default"):
                depth = 0
                while not (depth == 0 and self.at(":", "->")) and self.now.kind != "end":
                    depth += self.at("(", "[", "{") - self.at(")", "]", "}")
                    self.take()
                self.take()
                continue
            start = self.i
            try:
                out += self.statement()
            except (SyntaxTrouble, RecursionError) as e:
                self.recover(start, e)
        self.accept("}")
        return out

    # Expressions ------------------------------------------------------------------------------------------

    def arguments(self) -> list[Node]:
        self.expect("(")
        out = []
        while not self.at(")"):
            out.append(self.expression())
            if not self.accept(","):
                break
        self.expect(")")
        return out

    def array_initializer(self) -> Node:
        start = self.expect("{").start
        kids = []
        while not self.at("}"):
            kids.append(self.array_initializer() if self.at("{") else self.annotation() if self.at("@") else self.expression())
            if not self.accept(","):
                break
        self.expect("}")
        return Node("array", start, self.last_end(), "{" + ",".join(k.text for k in kids) + "}", kids)

    def expression(self) -> Node:
        left = self.ternary()
        if self.now.kind == "op" and (self.now.text in ASSIGN or self.shift_assign()):
            op = self.take().text
            while op[-1] == ">":
                op += self.take().text
            right = self.expression()
            return Node("assign", left.start, right.end, left.text + op + right.text, [left, right])
        return left

    def shift_assign(self) -> bool:
        return self.at(">") and self.peek().text == ">=" and self.peek().start == self.now.end or self.at(">") and self.peek().text == ">" and self.peek(2).text == ">=" and self.peek(2).start == self.now.end + 1

    def ternary(self) -> Node:
        left = self.binary()
        if self.accept("?"):
            a = self.lambda_() or self.ternary()
            self.expect(":")
            b = self.lambda_() or self.ternary()
            return Node("ternary", left.start, b.end, f"{left.text} ? {a.text} : {b.text}", [left, a, b])
        return left

    def binary(self) -> Node:
        left = self.unary()
        while True:
            if self.at("instanceof"):
                self.take()
                self.modifiers()
                kind = self.type()
                pattern = self.at("(") or self.now.kind == "id" and self.now.text not in KEYWORDS
                if self.at("("):
                    self.arguments()
                elif pattern:
                    self.take()
                left = Node("instanceof", left.start, self.last_end(), f"{left.text} instanceof {kind.text}", [left], type=kind, pattern=pattern)
            elif self.now.kind == "op" and self.now.text in BINARY or self.at("<", ">") and not self.shift_assign():
                op = self.take().text
                while op[-1] == ">" and self.at(">") and self.now.start == self.t[self.i - 1].end:
                    op += self.take().text
                right = self.unary()
                left = Node("infix", left.start, right.end, f"{left.text} {op} {right.text}", [left, right])
            else:
                return left

    def lambda_(self) -> Node | None:
        start = self.now
        if start.kind == "id" and self.peek().text == "->" and start.text not in KEYWORDS:
            self.i += 2
            head = start.text
        elif self.at("("):
            depth, j = 0, self.i
            while j < len(self.t) - 1:
                depth += (self.t[j].text == "(") - (self.t[j].text == ")")
                j += 1
                if depth == 0:
                    break
            if self.t[j].text != "->":
                return None
            head = "(" + ",".join(x.text for x in self.t[self.i + 1 : j - 1] if x.text != ",") + ")"
            self.i = j + 1
        else:
            return None
        if self.at("{"):
            kids, body = self.block(), "{}"
        else:
            kids = [self.expression()]
            body = kids[0].text
        return Node("lambda", start.start, self.last_end(), f"{head} -> {body}", kids)

    def unary(self) -> Node:
        found = self.lambda_()
        if found:
            return found
        tok = self.now
        if self.at("+", "-", "!", "~", "++", "--"):
            self.take()
            inner = self.unary()
            return Node("prefix", tok.start, inner.end, tok.text + inner.text, [inner])
        if self.at("("):
            cast = self.tentative(self.cast)
            if cast:
                return cast
        return self.postfix(self.primary())

    def cast(self) -> Node | None:
        start = self.expect("(").start
        kind = self.type()
        while self.accept("&"):
            self.type()
        self.expect(")")
        tok = self.now
        primitive = kind.text in PRIMITIVES
        starts = tok.kind in ("text", "num") or tok.kind == "id" and tok.text != "instanceof" or tok.text in ("(", "!", "~") or primitive and tok.text in ("+", "-", "++", "--")
        if not starts:
            return None
        inner = self.unary()
        return Node("cast", start, inner.end, f"({kind.text}){inner.text}", [*kind.kids, inner])

    def primary(self) -> Node:
        tok = self.now
        if tok.kind in ("text", "num"):
            self.take()
            return Node("literal", tok.start, tok.end, tok.text, value=tok.kind == "text" and tok.text[0] == '"')
        if self.at("("):
            self.take()
            inner = self.expression()
            self.expect(")")
            return Node("paren", tok.start, self.last_end(), f"({inner.text})", [inner])
        if self.at("new"):
            return self.creation(None)
        if self.at("switch"):
            self.take()
            head = self.parenthesized()
            return Node("switch", tok.start, self.last_end(), f"switch ({head[0].text}) {{}}", head + self.switch_body())
        if tok.kind == "id":
            if tok.text in PRIMITIVES:
                kind = self.type()
                if self.accept("."):
                    self.expect("class")
                    return Node("class_literal", kind.start, self.last_end(), kind.text + ".class")
                return Node("type_name", kind.start, kind.end, kind.text)
            if tok.text in ("this", "super", "null", "true", "false"):
                self.take()
                return Node(tok.text, tok.start, tok.end, tok.text)
            generic = self.tentative(self.type_reference)
            if generic:
                return generic
            self.name()
            if self.at("("):
                args = self.arguments()
                return Node("call", tok.start, self.last_end(), f"{tok.text}({','.join(a.text for a in args)})", args, name=tok, receiver=None)
            return Node("name", tok.start, tok.end, tok.text)
        raise SyntaxTrouble(f"unexpected {tok.text!r} at {tok.start}")

    def type_reference(self) -> Node | None:
        """A type where an expression stands: before :: (if generic or an array) or in an array's class literal."""
        kind = self.type()
        if "<" not in kind.text and not kind.text.endswith("[]"):
            return None
        if self.at("::"):
            return Node("type_name", kind.start, kind.end, kind.text, kind.kids)
        if self.at(".") and self.peek().text == "class":
            self.i += 2
            return Node("class_literal", kind.start, self.last_end(), kind.text + ".class")
        return None

    def creation(self, outer: Node | None) -> Node:
        start = self.expect("new").start
        if self.at("<"):
            self.type_arguments()
        kind = self.creation_type()
        begin = outer.start if outer else start
        if self.at("[") or self.at("{"):
            kids, text = list(kind.kids), kind.text
            while self.at("["):
                self.take()
                if self.at("]"):
                    text += "[]"
                else:
                    size = self.expression()
                    kids.append(size)
                    text += f"[{size.text}]"
                self.expect("]")
            if self.at("{"):
                init = self.array_initializer()
                kids.append(init)
                text += init.text
            return Node("new_array", begin, self.last_end(), f"new {text}", kids)
        args = self.arguments()
        text = f"{outer.text + '.' if outer else ''}new {kind.text}({','.join(a.text for a in args)})"
        kids = [*([outer] if outer else []), *kind.kids, *args]
        if self.at("{"):
            kids.append(Node("anonymous", self.now.start, self.now.end, kids=self.body("")))
            text += "{}"
        return Node("new", begin, self.last_end(), text, kids, type=kind)

    def creation_type(self) -> Node:
        return self.type(arrays=False)

    def postfix(self, e: Node) -> Node:
        while True:
            if self.at("."):
                nxt = self.peek()
                if nxt.text == "new":
                    self.take()
                    e = self.creation(e)
                    continue
                self.take()
                if self.at("<"):
                    self.type_arguments()
                tok = self.take()
                if tok.kind != "id":
                    raise SyntaxTrouble(f"unexpected {tok.text!r} at {tok.start}")
                if tok.text == "super" and self.at("::"):
                    e = Node("super", e.start, tok.end, e.text + ".super", [e])
                elif tok.text in ("this", "class", "super"):
                    e = Node(tok.text, e.start, tok.end, f"{e.text}.{tok.text}")
                elif self.at("("):
                    args = self.arguments()
                    e = Node("call", e.start, self.last_end(), f"{e.text}.{tok.text}({','.join(a.text for a in args)})", [e, *args], name=tok, receiver=e)
                else:
                    e = Node("access", e.start, tok.end, f"{e.text}.{tok.text}", [e])
            elif self.at("["):
                self.take()
                index = self.expression()
                self.expect("]")
                e = Node("index", e.start, self.last_end(), f"{e.text}[{index.text}]", [e, index])
            elif self.at("++", "--"):
                op = self.take()
                e = Node("postfix", e.start, op.end, e.text + op.text, [e])
            elif self.at("::"):
                self.take()
                if self.at("<"):
                    self.type_arguments()
                word = self.take()
                e = Node("reference", e.start, word.end, f"{e.text}::{word.text}", [e])
            else:
                return e


class Scope(NamedTuple):
    """Where a node stands: the enclosing method, and the class names that its members get."""

    method: str = ""
    #: What a method declared right here is prefixed with, and what a call without receiver is.
    owner: str = ""
    enclosing: str = ""
    #: The type declaration that is the direct parent, for names of nested types.
    outer: str = ""


class Fact(NamedTuple):
    """What a rule finds at a node: a full name or, of rules on types, a type as written; the symbol's own name; its place."""

    subject: str
    name: str
    place: Node | Token


class Rule(NamedTuple):
    """The symbol rows of one location that a kind of node gives."""

    node: str
    location: str
    kind: str
    facts: Callable[[Walk, Node, Scope], Iterable[Fact]]
    #: Whether subjects are types, which stand for all names that the imports allow.
    types: bool = False
    #: Where the row's annotations are, if it has any.
    marks: Callable[[Node, Node | None], list[Node]] | None = None


def _of_types(*places: str, name: Callable[[Node, Node, Scope], str], only: Callable[[Node, Scope], bool] = lambda n, s: True) -> Callable[[Walk, Node, Scope], Iterable[Fact]]:
    """Facts of the types that stand in some of a node's places, one or a list in each."""

    def facts(walk: Walk, node: Node, scope: Scope) -> Iterator[Fact]:
        for place in places if only(node, scope) else ():
            found = node.extra[place]
            for kind in found if isinstance(found, list) else [found] if found else []:
                kind = kind.extra["type"] if kind.kind == "parameter" else kind
                yield Fact(kind.text, name(node, kind, scope), kind)

    return facts


def _of_fragments(at_type: bool) -> Callable[[Walk, Node, Scope], Iterable[Fact]]:
    """A fact for each variable of a declaration, at the variable or at the type."""
    return lambda walk, node, scope: [Fact(node.extra["type"].text, f.text, node.extra["type"] if at_type else f) for f in node.extra["fragments"]]


def _itself(walk: Walk, node: Node, scope: Scope) -> list[Fact]:
    return [Fact(walk.full_name(node, scope), node.text, node)]


def _imported(walk: Walk, node: Node, scope: Scope) -> list[Fact]:
    name = node.text + ".*" * node.extra["star"]
    return [Fact(name, name, node)]


def _methods(walk: Walk, node: Node, scope: Scope) -> list[Fact]:
    """The method by its name and, where that says more, with its type parameters and parameters."""
    x, prefix = node.extra, scope.owner + "." * bool(scope.owner)
    out = [Fact(prefix + node.text, node.text, node)]
    if x["parameters"] or x["type_parameters"]:
        generics = f"<{','.join(x['type_parameters'])}>" if x["type_parameters"] else ""
        listed = ",".join(p.extra["type"].text for p in x["parameters"])
        out.append(Fact(f"{prefix}{generics}{node.text}({listed})", node.text, node))
    return out


def _locals_in_method(walk: Walk, node: Node, scope: Scope) -> list[Fact]:
    kind = node.extra["type"]
    return [Fact(kind.text, scope.method, kind) for _ in node.extra["fragments"]] if scope.method else []


def _calls(walk: Walk, node: Node, scope: Scope) -> list[Fact]:
    """The called method under each name that its receiver's type may have. A call on super is another kind of node."""
    called, receiver = node.extra["name"], node.extra["receiver"]
    if receiver is None:
        owners = [scope.enclosing]
    elif receiver.kind == "super":
        owners = []
    else:
        known = receiver.kind == "name" and (walk.locals.get(receiver.text) or walk.fields.get(receiver.text))
        owners = known or walk.resolve(receiver.text)
    return [Fact(f"{owner}.{called.text}" if owner else called.text, scope.method, called) for owner in owners]


def _used(walk: Walk, node: Node, scope: Scope) -> list[Fact]:
    return [Fact(node.extra["name"], node.extra["name"], node)]


def _own_marks(node: Node, parent: Node | None) -> list[Node]:
    return node.extra["annotations"]


def _sibling_marks(node: Node, parent: Node | None) -> list[Node]:
    """The annotations that stand beside one, itself included."""
    beside = parent.extra.get("annotations") if parent else None
    return beside if beside and node in beside else [node]


def _is(what: str, value: bool) -> Callable[[Node, Scope], bool]:
    return lambda node, scope: bool(node.extra[what]) is value


_decl, _type, _method = (lambda n, k, s: n.text), (lambda n, k, s: k.text), (lambda n, k, s: s.method)
_in_method, _outside = (lambda n, s: bool(s.method)), (lambda n, s: not s.method)
RULES = [
    Rule("package", "PACKAGE", "Module", lambda walk, node, scope: [Fact(node.text, node.text, node)]),
    Rule("import", "IMPORT", "Module", _imported),
    Rule("class", "CLASS", "Class", _itself, marks=_own_marks),
    Rule("class", "TYPE", "Class", _itself, marks=_own_marks),
    Rule("class", "INHERITANCE", "Class", _of_types("superclass", name=_decl), types=True),
    Rule("class", "INHERITANCE", "Class", _of_types("interfaces", name=_decl, only=_is("interface", True)), types=True),
    Rule("class", "IMPLEMENTS_TYPE", "Class", _of_types("interfaces", name=_decl, only=_is("interface", False)), types=True),
    Rule("enum", "CLASS", "Enum", _itself, marks=_own_marks),
    Rule("enum", "IMPLEMENTS_TYPE", "Class", _of_types("interfaces", name=_type), types=True),
    Rule("method", "METHOD", "Method", _methods, marks=_own_marks),
    Rule("method", "RETURN_TYPE", "Method", _of_types("returns", name=_decl), types=True),
    Rule("method", "TYPE", "Method", _of_types("parameters", "thrown", name=_decl), types=True),
    Rule("field", "FIELD", "Field", _of_fragments(at_type=False), types=True, marks=_own_marks),
    Rule("field", "TYPE", "Field", _of_fragments(at_type=True), types=True),
    Rule("local", "VARIABLE_DECLARATION", "Variable", _of_fragments(at_type=False), types=True),
    Rule("local", "TYPE", "Method", _locals_in_method, types=True),
    Rule("new", "CONSTRUCTOR_CALL", "Class", _of_types("type", name=_type), types=True),
    Rule("new", "TYPE", "Method", _of_types("type", name=_method, only=_in_method), types=True),
    Rule("call", "METHOD_CALL", "Method", _calls),
    Rule("annotation", "ANNOTATION", "Property", _used, types=True, marks=_sibling_marks),
    Rule("instanceof", "TYPE", "Method", _of_types("type", name=_method, only=lambda n, s: _in_method(n, s) and not n.extra["pattern"]), types=True),
    Rule("instanceof", "TYPE", "Class", _of_types("type", name=_type, only=lambda n, s: _outside(n, s) and not n.extra["pattern"]), types=True),
]
#: Kinds of nodes below which methods and types are named without a class.
CLOSED = ("record", "anonymous", "annotation_type")


class Walk:
    """One pass over a unit: the rules' rows at each node, and the scope below it."""

    def __init__(self, source: str, unit: Node) -> None:
        self.starts = [0, *[m.end() for m in re.finditer(r"\r\n|\n|\r", source)]]
        self.rows: list[Row] = []
        self.package = next((k.text for k in unit.kids if k.kind == "package"), "")
        imports = [k for k in unit.kids if k.kind == "import"]
        self.stars = [k.text for k in imports if k.extra["star"]]
        self.imports = {k.text.rpartition(".")[2]: k.text for k in imports if not k.extra["star"]}
        #: The types of the fields of the class, and of the variables of the method, that was entered last.
        self.fields: dict[str, list[str]] = {}
        self.locals: dict[str, list[str]] = {}
        for k in unit.kids:
            self.visit(k, Scope(), None)

    def place(self, at: int) -> tuple[int, int]:
        line = bisect.bisect_right(self.starts, at) - 1
        return line, at - self.starts[line]

    def resolve(self, name: str) -> list[str]:
        base = name.partition("<")[0]
        if "." in base:
            return [base]
        if base in self.imports:
            return [self.imports[base]]
        return [f"{star}.{base}" for star in self.stars] or [self.in_package(base)]

    def described(self, marks: list[Node]) -> list[dict[str, Any]]:
        return [{"qualified_name": self.resolve(m.extra["name"])[0], "elements": {k: element_text(v) for k, v in m.extra["elements"]}} for m in marks]

    def in_package(self, name: str) -> str:
        return f"{self.package}.{name}" if self.package else name

    def full_name(self, node: Node, scope: Scope) -> str:
        """Classes right inside classes go by both names, enums and all others by the package."""
        nested = node.kind == "class" and scope.outer and not node.extra.get("local")
        return f"{scope.outer}.{node.text}" if nested else self.in_package(node.text)

    def visit(self, node: Node, scope: Scope, parent: Node | None) -> None:
        self.enter(node)
        for rule in _BY_NODE.get(node.kind, ()):
            for fact in rule.facts(self, node, scope):
                marks = self.described(rule.marks(node, parent)) if rule.marks else []
                for name in self.resolve(fact.subject) if rule.types else [fact.subject]:
                    self.rows.append(Row(name, fact.name, rule.kind, rule.location, self.package, *self.place(fact.place.start), *self.place(fact.place.end), marks))
        inner = self.below(node, scope)
        for kid in node.kids:
            self.visit(kid, inner, node)

    def enter(self, node: Node) -> None:
        """Note the types of variables that a node declares."""
        if node.kind == "class":
            self.fields = {f.text: self.resolve(k.extra["type"].text) for k in node.kids if k.kind == "field" for f in k.extra["fragments"]}
        elif node.kind == "method":
            self.locals = {p.text: self.resolve(p.extra["type"].text) for p in node.extra["parameters"]}
        elif node.kind == "local":
            self.locals |= dict.fromkeys([f.text for f in node.extra["fragments"]], self.resolve(node.extra["type"].text))
        elif node.kind == "annotation_type":
            for kid in node.kids:
                kid.kind = "member" if kid.kind == "method" else kid.kind  # its elements are no methods

    def below(self, node: Node, scope: Scope) -> Scope:
        if node.kind in ("class", "enum"):
            full = self.full_name(node, scope)
            return Scope(scope.method, full, full, full if node.kind == "class" else "")
        if node.kind == "method":
            return scope._replace(method=node.text, outer="")
        return scope._replace(owner="", outer="") if node.kind in CLOSED else scope


_BY_NODE: dict[str, list[Rule]] = {}
for _rule in RULES:
    _BY_NODE.setdefault(_rule.node, []).append(_rule)


def element_text(value: Node) -> str:
    """An annotation element: string literals without quotes, arrays by their first element."""
    if value.kind == "literal" and value.extra.get("value"):
        return unescape(value.text)
    if value.kind == "array" and value.kids:
        return element_text(value.kids[0])
    return value.text


def unescape(literal: str) -> str:
    if literal.startswith('"""'):
        return literal[3:-3].partition("\n")[2]
    plain = {"n": "\n", "t": "\t", "b": "\b", "r": "\r", "f": "\f", "s": " "}
    return re.sub(r"\\(u+([0-9a-fA-F]{4})|[0-7]{1,3}|.)", lambda m: chr(int(m[2], 16)) if m[2] else chr(int(m[1], 8)) if m[1].isdigit() else plain.get(m[1], m[1]), literal[1:].removesuffix('"'))


def extract(source: str) -> tuple[list[Row], list[str]]:
    """(rows in visit order, errors). Broken members and statements are passed over, all others counted."""
    parser = Parser(source)
    unit = parser.unit()
    return Walk(source, unit).rows, parser.errors


def iter_rows(source: str) -> Iterator[Row]:
    yield from extract(source)[0]
