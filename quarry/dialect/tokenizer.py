"""SQL text to a tree of tokens and parenthesised groups, and back.

White space and comments are dropped (hints are kept), so rewrites see only
what counts; strings, quoted identifiers and hints are opaque tokens.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from quarry.errors import ParsingException

_TOKEN = re.compile(
    r"""
    (?P<space>\s+|--[^\n]*|/\*(?!\+).*?\*/)
  | (?P<hint>/\*\+.*?\*/)
  | (?P<string>'(?:[^']|'')*')
  | (?P<quoted>"(?:[^"]|"")*")
  | (?P<tick>`(?:[^`]|``)*`)
  | (?P<number>(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?)
  | (?P<word>[A-Za-z_\u0080-￿$][\w$]*)
  | (?P<sign><=>|->>|->|!~\*|!~|~\*|<>|!=|<=|>=|\|\||::|<<|>>|[-+*/%=<>.,;:?~^&|!@\#\[\]{}])
  | (?P<open>\()
  | (?P<close>\))
    """,
    re.S | re.X,
)


@dataclass
class Token:
    kind: str
    text: str

    @property
    def key(self) -> str:
        """Upper-case text of a bare word or sign, else empty."""
        return self.text.upper() if self.kind in ("word", "sign") else ""


@dataclass
class Group:
    """What stands between parentheses; the root has none around it."""

    items: list[Token | Group] = field(default_factory=list)
    root: bool = False
    #: Made by a rewrite, from parts that are rewritten already.
    done: bool = False
    #: Of the guard around a divisor: the divisor as it was.
    divisor: list | None = None
    key = ""
    kind = "group"


def tokens(sql: str) -> Iterator[Token]:
    at = 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise ParsingException(f"can't read SQL at: {sql[at : at + 30]!r}")
        at = m.end()
        if m.lastgroup != "space":
            yield Token(m.lastgroup, m[0])


def parse(sql: str) -> Group:
    stack = [Group(root=True)]
    for t in tokens(sql):
        if t.kind == "open":
            stack.append(Group())
            stack[-2].items.append(stack[-1])
        elif t.kind == "close":
            if len(stack) == 1:
                raise ParsingException("a closing parenthesis too many")
            stack.pop()
        else:
            stack[-1].items.append(t)
    if len(stack) > 1:
        raise ParsingException("a parenthesis isn't closed")
    return stack[0]


def render(node: Token | Group | list) -> str:
    if isinstance(node, Token):
        return node.text
    items = node if isinstance(node, list) else node.items
    text = " ".join(map(render, items))
    return text if isinstance(node, list) or node.root else f"({text})"


def written(items: list) -> str:
    """Text as it was written, without guards around divisors."""
    out = []
    for k, x in enumerate(items):
        if isinstance(x, Group) and x.divisor is not None:
            out[-1] = written(x.divisor)
        else:
            out.append(f"({written(x.items)})" if isinstance(x, Group) else x.text)
    return " ".join(out)


def statements(sql: str) -> list[Group]:
    """The statements between semicolons."""
    root = parse(sql)
    return [Group(part, root=True) for part in split(root.items, ";") if part]


def split(items: list, sign: str = ",") -> list[list]:
    """``items`` cut at each ``sign`` of this level, outside brackets."""
    out: list[list] = [[]]
    depth = 0
    for x in items:
        depth += {"[": 1, "]": -1}.get(x.key, 0)
        if x.kind == "sign" and x.text == sign and not depth:
            out.append([])
        else:
            out[-1].append(x)
    return out


def find(items: list, *words: str, start: int = 0) -> int:
    """Place of the word sequence at this level, or -1."""
    for k in range(start, len(items) - len(words) + 1):
        if all(items[k + j].key == w for j, w in enumerate(words)):
            return k
    return -1


def string_value(text: str) -> str:
    """What a string or quoted identifier stands for: quotes off, doubled quotes single."""
    return text[1:-1].replace(text[0] * 2, text[0])


def quote(value: str) -> str:
    """A Spark string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "''") + "'"


def tick(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def fragment(sql: str) -> list:
    """Items of Spark SQL text, which no rewrite touches again."""
    return _finish(parse(sql)).items


def _finish(group: Group) -> Group:
    group.done = True
    for x in group.items:
        if isinstance(x, Group):
            _finish(x)
        elif x.kind == "string":
            x.kind = "literal"
    return group
