"""Values of ``WITH (key = value, ...)``."""

from __future__ import annotations

from typing import Any

from quarry.dialect.tokenizer import Group, Token, find, render, split, string_value
from quarry.errors import ParsingException


def options(group: Group) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for part in split(group.items) if group.items else []:
        at = find(part, "=")
        if at < 1:
            raise ParsingException(f"an option needs a value: {render(part)}")
        key = "".join(string_value(t.text) if t.kind in ("string", "quoted") else t.text for t in part[:at])
        out[key] = value(part[at + 1 :])
    return out


def value(items: list) -> Any:
    if not items:
        raise ParsingException("an option's value is missing")
    head = items[0]
    if head.key in ("ARRAY", "MULTISET", "MAP"):
        inner = _bracket(items[1:])
        found = [value(x) for x in split(inner)] if inner else []
        if head.key == "ARRAY":
            return found
        if head.key == "MULTISET":
            return set(found)
        if len(found) % 2:
            raise ParsingException("a MAP needs pairs")
        return dict(zip(found[::2], found[1::2], strict=True))
    if isinstance(head, Group):
        if len(items) > 1:
            raise ParsingException(f"can't read the value {render(items)}")
        return options(head) if find(head.items, "=") >= 0 else tuple(value(x) for x in split(head.items))
    if head.key == "[":
        inner = _bracket(items)
        return [value(x) for x in split(inner)] if inner else []
    sign = -1 if head.key == "-" else 1
    rest = items[1:] if head.key in ("-", "+") else items
    if len(rest) == 1 and isinstance(rest[0], Token):
        t = rest[0]
        if t.kind == "number":
            return sign * (int(t.text) if t.text.isdigit() else float(t.text))
        if t.kind in ("string", "quoted", "literal"):
            return string_value(t.text)
        if t.key in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[t.key]
        if t.kind in ("word", "tick"):
            return t.text.strip("`")
    return "".join(render(t) for t in items)


def _bracket(items: list) -> list:
    if not items or items[0].key != "[" or items[-1].key != "]":
        raise ParsingException("brackets are expected")
    return items[1:-1]
