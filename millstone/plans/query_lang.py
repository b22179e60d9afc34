"""The boolean query language: lexer, parser, syntax tree.

``AND``/``&``, ``OR``/``|`` and ``AND NOT`` with parentheses; values next to each other are alternatives
and bind loosest. A value is a quoted string (escapes are kept as written) or any run of characters
without white space and parentheses. Keywords in any case are keywords only as whole tokens: the longest
match wins.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from millstone.errors import InvalidError, LimitError

NESTING = 100
_SPACE = " \t\v\f\r\n"
_RULES = [
    ("AND", re.compile(r"&|and", re.I)),
    ("OR", re.compile(r"\||or", re.I)),
    ("NOT", re.compile(r"not", re.I)),
    ("(", re.compile(r"\(")),
    (")", re.compile(r"\)")),
    ("QUOTED", re.compile(r"'(?:[^\x00'\\]|\\[^\x00])*'|\"(?:[^\x00\"\\]|\\[^\x00])*\"", re.S)),
    ("WORD", re.compile(r"[^\x00 \t\v\f\r\n()]+")),
]


@dataclass(frozen=True)
class Leaf:
    value: str

    def __str__(self):
        return f"`{self.value}`"


@dataclass(frozen=True)
class Node:
    op: str  # AND, OR, or NOT (left but not right)
    left: Node | Leaf
    right: Node | Leaf

    def __str__(self):
        return f"({self.op} {self.left} {self.right})"


@dataclass(frozen=True)
class Token:
    kind: str
    value: str
    at: int


def lex(query: str) -> list[Token]:
    """Tokens, ended by one of kind END; a NUL ends the query."""
    out, at = [], 0
    query = query.split("\x00", 1)[0]
    while at < len(query):
        if query[at] in _SPACE:
            at += 1
            continue
        kind, end = max(((k, m.end()) for k, r in _RULES if (m := r.match(query, at))), key=lambda x: x[1], default=("", at))
        if end == at:
            raise _wrong(query, at)
        text = query[at:end]
        out.append(Token("VALUE" if kind in ("QUOTED", "WORD") else kind, text[1:-1] if kind == "QUOTED" else text, at))
        at = end
    return [*out, Token("END", "", len(query))]


def _wrong(query: str, at: int) -> InvalidError:
    before = query[:at]
    line = before.count("\n") + 1
    return InvalidError(f'syntax error near {line}:{at - (before.rfind("\n") + 1)}: "{query[at : at + 50]} ..."')


class _Parser:
    def __init__(self, query: str):
        self.query, self.tokens, self.i = query, lex(query), 0

    @property
    def kind(self) -> str:
        return self.tokens[self.i].kind

    def take(self, kind: str) -> Token:
        if self.kind != kind:
            raise _wrong(self.query, self.tokens[self.i].at)
        self.i += 1
        return self.tokens[self.i - 1]

    def whole(self):
        tree = self.either()
        while self.kind != "END":
            tree = Node("OR", tree, self.either())
        return tree

    def either(self):
        tree = self.both()
        while self.kind == "OR":
            self.i += 1
            tree = Node("OR", tree, self.both())
        return tree

    def both(self):
        tree = self.single()
        while self.kind == "AND":
            self.i += 1
            op = "AND"
            if self.kind == "NOT":
                self.i += 1
                op = "NOT"
            tree = Node(op, tree, self.single())
        return tree

    def single(self):
        depth = 0
        while self.kind == "(":
            depth += 1
            self.i += 1
            if depth > 10 * NESTING:
                raise LimitError(f"query nesting limit reached ({NESTING} levels)")
        tree = Leaf(self.take("VALUE").value)
        while depth:
            # what is inside a parenthesis goes on as an expression that starts with what is read so far
            tree = self._rest(tree)
            self.take(")")
            depth -= 1
        return tree

    def _rest(self, tree):
        while self.kind == "AND":
            self.i += 1
            op = "AND"
            if self.kind == "NOT":
                self.i += 1
                op = "NOT"
            tree = Node(op, tree, self.single())
        while self.kind == "OR":
            self.i += 1
            tree = Node("OR", tree, self.both())
        return tree


def parse(query: str) -> Node | Leaf:
    """The syntax tree; InvalidError where the query is none, LimitError where it is nested too deep."""
    tree = _Parser(query).whole()
    check_depth(tree)
    return tree


def check_depth(tree: Node | Leaf) -> None:
    todo = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        if depth > NESTING:
            raise LimitError(f"query nesting limit reached ({NESTING} levels)")
        if isinstance(node, Node):
            todo += [(node.left, depth + 1), (node.right, depth + 1)]


def leaves(tree: Node | Leaf) -> list[str]:
    """Values from left to right, repeats included."""
    if isinstance(tree, Leaf):
        return [tree.value]
    return leaves(tree.left) + leaves(tree.right)
