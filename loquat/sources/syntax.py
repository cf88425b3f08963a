"""A small syntax tree of Swift source: declarations, calls, member chains, assignments.

It knows what the extraction operators ask for and passes over everything else, so any text parses.
Trees are walked outermost call first: a call, then what it is called on, its arguments, its closures.
A tree is no larger than a statement: bodies of declarations and of control statements are handed on statement by statement.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass, field
from itertools import islice

from loquat.sources.lexer import END, NAME, NUMBER, OPERATOR, SIGN, STRING, Source, Token

_TYPES = {"struct", "class", "enum", "extension", "actor", "protocol"}
_NAMED_TYPES = {"struct", "class", "enum", "extension"}
_STATEMENTS = {"if", "guard", "while", "for", "in", "switch", "case", "default", "where", "return", "throw", "defer", "do", "catch", "repeat", "else", "break", "continue", "fallthrough", "import", "try", "await", "is", "as", "inout", "some", "any", "indirect", "lazy", "weak", "unowned"}
#: Words before a block that belongs to the statement, not to a call.
_CONDITIONS = {"if", "guard", "while", "for", "switch"}
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


@dataclass(slots=True)
class Node:
    """kind: name, member, call, string, number, nil, bool, closure, array, dictionary, key_path, other, sequence, block, item, type, variable, function."""

    kind: str
    start: int
    end: int = 0
    name: str = ""
    children: list[Node] = field(default_factory=list)
    #: call: the callee; member: the base, if any.
    base: Node | None = None
    #: call: (label, expression) in order.
    arguments: list[tuple[str | None, Node]] = field(default_factory=list)
    interpolated: bool = False
    static: bool = False
    #: variable: (name, initial value).
    bindings: list[tuple[str | None, Node | None]] = field(default_factory=list)
    parameters: bool = False
    returns: str = ""


def nodes(source: Source, scope: tuple, inside: Callable[[Node, tuple], tuple | None]) -> Iterator[tuple[Node, tuple]]:
    """Nodes in visiting order, each with the scope it lies in; ``scope`` is that of the whole text.

    ``inside`` tells the scope in a declaration or control statement whose body begins (its node is handed on with what it has by then), or null to
    have the body in its tree. A node that was handed on and has more behind its body comes again, with that only."""
    parser = _Parser(source.tokens(), source.passed)
    while parser.now.kind != END:
        before = parser.now
        yield from parser.block_items(None, scope, inside)
        if parser.now.kind != END and parser.now is before or parser.now.text in _CLOSERS.values():
            parser.take()  # a stray closing bracket


#: Tokens that can be looked at ahead of the present one; the parser always has so many more.
_AHEAD, _FILL = 64, 2048


def _whole(steps: Generator):
    """What steps return that hand nothing on."""
    try:
        next(steps)
    except StopIteration as end:
        return end.value
    raise AssertionError("handed on")


class _Parser:
    def __init__(self, tokens: Iterator[Token], passed: Callable[[int], None] = lambda offset: None):
        self.source, self.passed = iter(tokens), passed
        self.tokens: list[Token] = list(islice(self.source, _FILL))
        self.at, self.now = 0, self.tokens[0]

    def fill(self) -> bool:
        """More tokens, if there are any."""
        new = list(islice(self.source, _FILL))
        self.tokens += new
        return bool(new)

    def drop(self) -> None:
        """What lies before the present token is done, but for the last one's end."""
        if self.at > _FILL:
            del self.tokens[: self.at - 1]
            self.at = 1
            self.passed(self.tokens[0].start)

    def peek(self, n: int = 1) -> Token:
        return self.tokens[min(self.at + n, len(self.tokens) - 1)]

    def take(self) -> Token:
        token = self.now
        if token.kind != END:
            self.at = at = self.at + 1
            if at + _AHEAD >= len(self.tokens):
                self.fill()
            self.now = self.tokens[at]
        return token

    def to(self, at: int) -> None:
        self.at = at
        if at + _AHEAD >= len(self.tokens):
            self.fill()
        self.now = self.tokens[at]

    def sign(self, text: str) -> bool:
        return self.now.text == text and self.now.kind in (SIGN, OPERATOR)

    # Statements and declarations

    def block_items(self, closer: str | None, scope: tuple | None = None, inside=None) -> Generator:
        """Hands items on with their scope, or returns them if there is none."""
        items = []
        while self.now.kind != END and not (closer and self.sign(closer)) and not (not closer and self.now.text in _CLOSERS.values()):
            before = self.now
            node = yield from self.item(scope, inside)
            if scope is None:
                items.append(node)
            else:
                yield node, scope
                self.drop()
            if self.now is before:
                self.take()
        return items

    def block(self, scope: tuple | None = None, inside=None) -> Generator:
        """From an opening brace to its closing one."""
        start = self.take().start
        items = yield from self.block_items("}", scope, inside)
        end = self.take().end if self.sign("}") else self.now.end
        return Node("block", start, end, children=items)

    def body(self, node: Node, scope: tuple | None, inside) -> Generator:
        """A block of a node: in its tree, or handed on behind the node itself."""
        within = None if scope is None else inside(node, scope)
        if within is not None:
            yield node, scope
            node.children = []
        block = yield from self.block(within, inside)
        if within is None:
            node.children.append(block)
        node.end = block.end

    def item(self, scope: tuple | None = None, inside=None) -> Generator:
        start, static = self.now.start, False
        while self.now.kind == NAME:
            word = self.now.text
            if word.startswith("@"):
                self.take()
                if self.sign("(") and not self.now.spaced:
                    self.skip_brackets()
            elif word in ("static", "class") and self.peek().kind == NAME and self.peek().text in ("let", "var", "func", "private", "public", "internal", "fileprivate", "override", "final", "static"):
                static |= word == "static"
                self.take()
            elif word in ("public", "private", "internal", "fileprivate", "open", "final", "override", "mutating", "nonmutating", "convenience", "required", "lazy", "weak", "unowned", "dynamic", "nonisolated", "indirect", "optional", "prefix", "postfix", "infix") and self.peek().kind in (NAME, SIGN):
                self.take()
                if self.sign("(") and not self.now.spaced:
                    self.skip_brackets()
            else:
                break
        word = self.now.text if self.now.kind == NAME else ""
        if word in _TYPES and self.peek().kind == NAME:
            return self.wrapped((yield from self.type_declaration(start, scope, inside)))
        if word in ("let", "var"):
            return self.wrapped((yield from self.variable(start, static, scope, inside)))
        if word == "func" or word == "init" and self.peek().text in ("(", "?", "!", "<") or word in ("subscript", "deinit") and self.peek().text in ("(", "{", "<"):
            return self.wrapped((yield from self.function(start, scope, inside)))
        if word in ("typealias", "associatedtype", "import", "precedencegroup"):
            self.take()
            while self.now.kind != END and not self.now.fresh and not self.sign(";"):
                self.take()
            return Node("item", start, self.now.start)
        return (yield from self.statement(start, scope, inside))

    @staticmethod
    def wrapped(node: Node) -> Node:
        return Node("item", node.start, node.end, children=[node])

    def type_declaration(self, start: int, scope: tuple | None, inside) -> Generator:
        keyword = self.take().text
        name_token = self.take()
        name, end = name_token.text, name_token.end
        while self.sign(".") and self.peek().kind == NAME:
            self.take()
            name += "." + self.take().text
        node = Node("type", start, end, name=name if keyword in _NAMED_TYPES else "")
        while self.now.kind != END and not self.sign("{"):
            if self.sign("}"):
                return node
            self.take()
        node.returns = keyword
        if self.sign("{"):
            yield from self.body(node, scope, inside)
        return node

    def function(self, start: int, scope: tuple | None, inside) -> Generator:
        keyword = self.take().text
        name = self.take().text if keyword == "func" else keyword
        if self.sign("<") or self.now.text.startswith("<"):
            self.skip_generics()
        node = Node("function", start, name=name if keyword == "func" else "")
        if self.sign("("):
            opened = self.at
            node.children += self.default_values()
            node.parameters = self.at > opened + 2
        while self.now.kind != END and not self.sign("{") and not self.sign("}") and not (self.now.fresh and self.now.text not in ("where", "->", "throws", "async", "rethrows")):
            if self.now.text == "->":
                self.take()
                node.returns = self.now.text + ("" if self.peek().text in ("{", "where", "}") or self.peek().fresh else "…")
            else:
                self.take()
        if self.sign("{"):
            yield from self.body(node, scope, inside)
        node.end = self.tokens[self.at - 1].end
        return node

    def default_values(self) -> list[Node]:
        """Parameter list: only default values are expressions."""
        out, depth = [], 0
        while self.now.kind != END:
            if self.now.text in ("(", "["):
                depth += 1
            elif self.now.text in (")", "]"):
                depth -= 1
                if not depth:
                    self.take()
                    return out
            elif self.sign("=") and depth == 1:
                self.take()
                out.append(self.expression())
                continue
            elif self.sign("}"):
                return out
            self.take()
        return out

    def variable(self, start: int, static: bool, scope: tuple | None, inside) -> Generator:
        self.take()
        node = Node("variable", start, static=static)
        while True:
            name = None
            if self.now.kind == NAME:
                name = self.take().text
            elif self.sign("("):
                self.skip_brackets()
            if self.sign(":"):
                self.skip_type()
            value = None
            if self.sign("="):
                self.take()
                value = self.expression()
                node.children.append(value)
            node.bindings.append((name, value))
            if self.sign("{"):
                yield from self.body(node, scope, inside)
            if self.sign(",") and self.peek().kind == NAME and self.peek(2).text in (":", "="):
                self.take()
                continue
            break
        node.end = self.tokens[self.at - 1].end
        return node

    def skip_type(self) -> None:
        self.take()
        first = True
        while self.now.kind != END and not self.sign("=") and not self.sign("{") and not self.sign(",") and not self.sign(")") and not self.sign("}") and not self.sign(";"):
            if self.now.fresh and not first:
                return
            first = False
            if self.now.text in ("(", "["):
                self.skip_brackets()
            elif self.now.text == "<":
                self.skip_generics()
            elif self.now.kind == OPERATOR and self.now.text.endswith("=") and self.now.text.strip("?!>=") == "":
                self.now.text = "="  # "String?=": the sign ends the type
                return
            else:
                self.take()

    def skip_generics(self) -> None:
        depth = 0
        while self.now.kind != END and self.now.text not in ("{", "}", ")"):
            depth += self.now.text.count("<") - (self.now.text.count(">") if self.now.text != "->" else 0)
            if self.now.text == "(":
                self.skip_brackets()
                continue
            self.take()
            if depth <= 0:
                return

    def skip_brackets(self) -> None:
        depth = 0
        while self.now.kind != END:
            depth += (self.now.text in ("(", "[")) - (self.now.text in (")", "]"))
            self.take()
            if depth <= 0:
                return

    def statement(self, start: int, scope: tuple | None, inside) -> Generator:
        """Expressions up to the next statement; blocks of control statements are walked as blocks."""
        node, condition, begun = Node("item", start), False, False
        while self.now.kind != END:
            token = self.now
            if token.text in (")", "]", "}") and token.kind == SIGN:
                break
            if token.text == ";":
                self.take()
                break
            if begun and token.fresh and not condition and token.text not in ("else", "catch", "where"):
                break
            if token.kind == NAME and token.text in _STATEMENTS:
                condition |= token.text in _CONDITIONS or token.text == "catch"
                self.take()
                if token.text in ("return", "break", "continue", "fallthrough", "default") and self.now.fresh:
                    break
                if token.text in ("do", "defer", "repeat", "else", "catch") and self.sign("{"):
                    yield from self.body(node, scope, inside)
                    condition, begun = False, True
                continue
            if token.text in ("let", "var") and token.kind == NAME:
                self.take()
                continue
            if self.sign("{") and condition:
                yield from self.body(node, scope, inside)
                condition, begun = False, True
                continue
            if token.text in (",", ":", "=", "_"):
                self.take()
                continue
            before = self.at
            node.children.append(self.expression(trailing=not condition))
            begun = True
            if self.at == before:
                self.take()
        node.end = self.tokens[max(self.at - 1, 0)].end
        return node

    # Expressions

    def expression(self, trailing: bool = True) -> Node:
        """Operands and operators up to a comma, a closing bracket or the next line's statement."""
        start, elements = self.now.start, []
        while self.now.kind != END:
            token = self.now
            if token.kind == NAME and token.text in ("try", "await", "as", "is", "inout", "some", "any") and not (token.fresh and elements):
                self.take()
                if token.text in ("as", "is"):
                    elements.append(Node("operator", token.start, name=token.text))
                while self.now.kind == OPERATOR and self.now.text in ("?", "!"):
                    self.take()
                continue
            if token.kind == OPERATOR:
                if token.fresh and elements and token.text in ("-", "!", "&", "~") and not self.peek().spaced:
                    break  # a prefix operator begins a statement
                self.take()
                if not self.now.spaced and (token.spaced or not elements) and token.text not in ("=", "??", "&&", "||"):
                    continue  # prefix
                elements.append(Node("operator", token.start, token.end, name=token.text))
                continue
            if token.kind == SIGN and token.text == ":" and any(e.kind == "operator" and e.name == "?" for e in elements):
                self.take()
                elements.append(Node("operator", token.start, name=":"))
                continue
            if elements and elements[-1].kind != "operator":
                break
            if token.kind == SIGN and token.text in (",", ";", ":", ")", "]", "}"):
                break
            if token.text == "{" and not trailing:
                break
            if token.kind == NAME and token.text in _STATEMENTS and elements:
                break
            before = self.at
            elements.append(self.postfix(trailing))
            if self.at == before:
                break
        end = self.tokens[max(self.at - 1, 0)].end
        if len(elements) == 1:
            return elements[0]
        return Node("sequence", start, end, children=elements)

    def postfix(self, trailing: bool) -> Node:
        node = self.primary(trailing)
        while self.now.kind != END:
            token = self.now
            if token.text == "." and token.kind == SIGN and (self.peek().kind in (NAME, NUMBER)):
                self.take()
                name = self.take()
                node = Node("member", node.start, name.end, name=name.text.strip("`"), base=node)
            elif token.kind == OPERATOR and token.text in ("?", "!", "?!") and not token.spaced:
                self.take()
                node = Node("other", node.start, token.end, name="optional", children=[node])
            elif token.text == "(" and not token.fresh and (not token.spaced or node.kind == "call"):
                node = self.call(node)
                if trailing:
                    self.closures(node)
            elif token.text == "[" and not token.spaced:
                arguments = self.brackets()
                node = Node("other", node.start, self.tokens[self.at - 1].end, name="subscript", children=[node, *(e for _, e in arguments)])
            elif token.text == "{" and trailing and not token.fresh and node.kind in ("name", "member"):
                node = Node("call", node.start, base=node)
                self.closures(node)
            elif token.text == "<" and not token.spaced and node.kind in ("name", "member") and self.generic_call():
                self.skip_generics()
            else:
                break
        return node

    def generic_call(self) -> bool:
        """Whether an opening angle bracket closes before a bracket, as in ``Array<Int>(...)``."""
        depth = 0
        for k in range(self.at, min(self.at + 40, len(self.tokens))):
            text = self.tokens[k].text
            if self.tokens[k].kind == STRING or text in ("{", "}", ";", "=") or self.tokens[k].fresh and k > self.at:
                return False
            depth += text.count("<") - text.count(">")
            if depth <= 0:
                return self.tokens[min(k + 1, len(self.tokens) - 1)].text in ("(", ".", "{")
        return False

    def call(self, callee: Node) -> Node:
        node = Node("call", callee.start, base=callee)
        node.arguments = self.brackets()
        node.end = self.tokens[self.at - 1].end
        return node

    def brackets(self) -> list[tuple[str | None, Node]]:
        """(label, expression) between brackets, which are taken too."""
        closer, out = _CLOSERS[self.take().text], []
        while self.now.kind != END and not self.sign(closer):
            if self.now.kind == SIGN and self.now.text in (")", "]", "}"):
                break
            before, label = self.at, None
            if self.now.kind == NAME and self.peek().text == ":" and self.peek().kind == SIGN:
                label = self.take().text.strip("`")
                self.take()
            out.append((label, self.expression()))
            while self.now.text in (",", ":", ";") and self.now.kind == SIGN:
                self.take()
            if self.at == before:
                self.take()
        if self.sign(closer):
            self.take()
        return out

    def closures(self, node: Node) -> None:
        """Trailing closures, labelled ones included."""
        while self.sign("{") and not self.now.fresh or node.children and self.now.kind == NAME and self.peek().text == ":" and self.peek(2).text == "{":
            if self.now.kind == NAME:
                self.take()
                self.take()
            node.children.append(self.closure())
        node.end = self.tokens[self.at - 1].end

    def closure(self) -> Node:
        start = self.take().start
        for k in range(self.at, min(self.at + 60, len(self.tokens))):  # a signature ends with "in"
            token = self.tokens[k]
            if token.kind == STRING or token.text in ("{", "}") or token.kind == END or token.fresh and k > self.at and token.text != "in":
                break
            if token.text == "in" and token.kind == NAME:
                self.to(k + 1)
                break
        items = _whole(self.block_items("}"))
        end = self.take().end if self.sign("}") else self.now.end
        return Node("closure", start, end, children=items)

    def primary(self, trailing: bool) -> Node:
        token = self.now
        if token.kind == STRING:
            self.take()
            node = Node("string", token.start, token.end, name=token.text, interpolated=token.interpolated)
            for inner in token.inner:
                parser = _Parser(inner)
                while parser.now.kind != END:
                    before = parser.at
                    node.children.append(parser.expression())
                    if parser.at == before or parser.now.kind == SIGN:
                        parser.take()
            return node
        if token.kind == NUMBER:
            self.take()
            return Node("number", token.start, token.end, name=token.text)
        if token.kind == NAME:
            self.take()
            kind = {"nil": "nil", "true": "bool", "false": "bool"}.get(token.text, "name")
            return Node(kind, token.start, token.end, name=token.text.strip("`"))
        if token.text == "." and self.peek().kind == NAME:
            self.take()
            name = self.take()
            return Node("member", token.start, name.end, name=name.text.strip("`"))
        if token.text == "(":
            parts = self.brackets()
            return Node("other", token.start, self.tokens[self.at - 1].end, name="tuple", children=[e for _, e in parts])
        if token.text == "[":
            keyed = self.keyed()
            parts = self.brackets()
            return Node("dictionary" if keyed else "array", token.start, self.tokens[self.at - 1].end, children=[e for _, e in parts])
        if token.text == "{":
            return self.closure()
        if token.text == "\\":
            self.take()
            while self.now.text in (".", "?", "!") or self.now.kind == NAME and self.tokens[self.at - 1].text in (".", "\\"):
                self.take()
            return Node("key_path", token.start, self.tokens[self.at - 1].end)
        self.take()
        return Node("other", token.start, token.end, name=token.text)

    def keyed(self) -> bool:
        """Whether a square bracket opens a dictionary."""
        depth = 0
        k = self.at - 1
        while (k := k + 1) < len(self.tokens) or self.fill():
            text, kind = self.tokens[k].text, self.tokens[k].kind
            if kind != STRING:
                depth += (text in ("(", "[", "{")) - (text in (")", "]", "}"))
                if text == ":" and depth == 1:
                    return True
            if depth <= 0 or kind == END:
                return False
        return False
