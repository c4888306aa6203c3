"""Rewrites of what Spark SQL can't parse or reads differently; all else passes as it is.

- strings: a backslash is an ordinary character;
- "x" is an identifier;
- ORDER BY puts NULLs last ascending and first descending unless told;
- an ordered window without a frame counts rows up to the current one;
- functions whose syntax or meaning differs (``FUNCTIONS``);
- SIMILAR TO, LIKE ... ESCAPE, TABLESAMPLE SYSTEM | BERNOULLI;
- QUALIFY, RIGHT SEMI | ANTI JOIN; ``~ !~ ~* !~*`` (regular expressions) and ``#`` (exclusive or);
- what is divided by zero is NULL;
- ``APPROX_COUNT_DISTINCT`` beside aggregates of DISTINCT values takes each value once.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from quarry.dialect.tokenizer import Group, Token, find, fragment, quote, render, split, string_value, tick
from quarry.errors import ParsingException
from quarry.functions import templates as T

#: Words that end an ORDER BY list at its level.
ORDER_ENDS = {"LIMIT", "OFFSET", "FETCH", "ROWS", "RANGE", "GROUPS", "UNION", "INTERSECT", "EXCEPT", "MINUS", "WINDOW", "DISTRIBUTE", "CLUSTER", "SORT", "SEPARATOR"}
#: Window functions that take no frame.
FRAMELESS = {"ROW_NUMBER", "RANK", "DENSE_RANK", "PERCENT_RANK", "CUME_DIST", "NTILE", "LEAD", "LAG"}
FRAME = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def rewrite(root: Group) -> Group:
    _walk(root)
    return root


def _walk(group: Group) -> None:
    _literals(group)
    _group_frames(group)
    _qualify(group)
    _right_semi(group)
    _distinct_sketches(group)
    for k, x in enumerate(group.items):
        if isinstance(x, Group) and not x.done:
            if k and group.items[k - 1].key in ("TO_TIMESTAMP", "DSQL_TOTIMESTAMP"):
                for t in x.items[-1:]:  # here double quotes may stand around the format
                    if t.kind == "quoted":
                        t.kind, t.text = "string", "'" + string_value(t.text).replace("'", "''") + "'"
            _walk(x)
    _functions(group)
    _regular(group)
    _zero_divisors(group)
    _similar(group)
    _like_escape(group)
    _sample(group)
    _windows(group)
    _order(group)


def _literals(group: Group) -> None:
    for t in group.items:
        if t.kind == "string":
            t.text = quote(string_value(t.text))
            t.kind = "literal"
        elif t.kind == "quoted":
            t.kind, t.text = "tick", tick(string_value(t.text))


def literal_value(t: Token) -> str:
    """The value of a string token, before or after ``_literals``."""
    if t.kind == "literal":
        return re.sub(r"\\(.)", r"\1", string_value(t.text), flags=re.S)
    return string_value(t.text)


def _functions(group: Group) -> None:
    out: list = []
    items, k = group.items, 0
    while k < len(items):
        x, call = items[k], k + 1 < len(items) and isinstance(items[k + 1], Group)
        before = items[k - 1].key if k else ""
        if x.kind == "word" and before != ".":
            if call and x.key == "$SUM0" and k + 3 < len(items) and items[k + 2].key == "OVER" and isinstance(items[k + 3], Group):
                inner = Group([Token("word", "sum"), *items[k + 1 : k + 4], Token("sign", ","), Token("number", "0")])
                _windows(inner)
                out += [Token("word", "coalesce"), inner]
                k += 4
                continue
            if call and (make := FUNCTIONS.get(x.key)) and (new := make(items[k + 1])) is not None:
                out += fragment(new)
                k += 2
                continue
            if before == "AS" and x.key in ("VARCHAR", "CHAR", "TEXT") and not call and k + 1 == len(items):
                x.text = "STRING"  # the type of a CAST, at its end
            if not call and x.key in BARE and before != "AS":
                out += fragment(BARE[x.key])
                k += 1
                continue
        out.append(x)
        k += 1
    group.items = out


def _args(group: Group) -> list[str]:
    return [render(a) for a in split(group.items)] if group.items else []


def _plain(make: Callable[..., str], least: int, most: int | None = None) -> Callable[[Group], str | None]:
    def call(group: Group) -> str | None:
        args = _args(group)
        return make(*args) if least <= len(args) <= (most or least) else None

    return call


def _unit_call(make: Callable[[str, str], str]) -> Callable[[Group], str | None]:
    """``CEIL(x TO unit)``; without TO the number function."""

    def call(group: Group) -> str | None:
        at = find(group.items, "TO")
        if at > 0 and at + 2 == len(group.items):
            return T.by_unit(make.__name__, render(group.items[:at]), group.items[at + 1].key)
        args = _args(group)
        return make(*args) if len(args) == 1 else None

    return call


def _extract(group: Group) -> str | None:
    at = find(group.items, "FROM")
    return T.extract(group.items[0].key or literal_value(group.items[0]), render(group.items[2:])) if at == 1 else None


def _date_part(group: Group) -> str | None:
    parts = split(group.items)
    if len(parts) == 2 and len(parts[0]) == 1 and parts[0][0].kind in ("string", "literal"):
        return T.extract(literal_value(parts[0][0]), render(parts[1]))
    return None


def _timestamp(make: Callable[[str, str, str], str]) -> Callable[[Group], str | None]:
    def call(group: Group) -> str | None:
        parts = split(group.items)
        return make(T.unit_name(render(parts[0])), render(parts[1]), render(parts[2])) if len(parts) == 3 else None

    return call


def _to_timestamp(group: Group) -> str | None:
    parts = split(group.items)
    if len(parts) not in (1, 2):
        return None
    form = None
    if len(parts) == 2:
        if len(parts[1]) != 1 or parts[1][0].kind not in ("string", "quoted", "literal"):
            return None
        form = string_value(parts[1][0].text) if parts[1][0].kind == "quoted" else literal_value(parts[1][0])
    return T.to_timestamp(render(parts[0]), form)


def _position(group: Group) -> str | None:
    at = find(group.items, "IN")
    if at < 0:
        return None
    since = find(group.items, "FROM", start=at)
    end = len(group.items) if since < 0 else since
    return T.position(render(group.items[:at]), render(group.items[at + 1 : end]), render(group.items[since + 1 :]) if since > 0 else None)


def _substring(group: Group) -> str | None:
    at, to = find(group.items, "FROM"), find(group.items, "FOR")
    if at < 0:
        args = _args(group)
        return T.substring(*args) if len(args) in (2, 3) else None
    end = len(group.items) if to < 0 else to
    return T.substring(render(group.items[:at]), render(group.items[at + 1 : end]), *([render(group.items[to + 1 :])] if to > 0 else []))


def _overlay(group: Group) -> str | None:
    by, at, to = (find(group.items, w) for w in ("PLACING", "FROM", "FOR"))
    if by < 0 or at < 0:
        args = _args(group)
        return T.overlay(*args) if len(args) in (3, 4) else None
    end = len(group.items) if to < 0 else to
    return T.overlay(render(group.items[:by]), render(group.items[by + 1 : at]), render(group.items[at + 1 : end]), *([render(group.items[to + 1 :])] if to > 0 else []))


def _by_extreme(kind: str) -> Callable[[Group], str | None]:
    def call(group: Group) -> str | None:
        parts = split(group.items)
        return T.by_extreme(kind, *map(render, parts)) if len(parts) == 2 and parts[0][0].key not in ("DISTINCT", "ALL") else None

    return call


def ceil(x: str) -> str:
    return T.ceil(x)


def floor(x: str) -> str:
    return T.floor(x)


#: Calls that change on the way to Spark.
FUNCTIONS: dict[str, Callable[[Group], str | None]] = {
    "CEIL": _unit_call(ceil), "CEILING": _unit_call(ceil), "FLOOR": _unit_call(floor),
    "EXTRACT": _extract, "DATE_PART": _date_part, "EXTRACT_DATE": _plain(lambda x: f"to_date({x})", 1),
    "TIMESTAMPADD": _timestamp(T.timestamp_add), "TIMESTAMPDIFF": _timestamp(T.timestamp_diff),
    "TO_TIMESTAMP": _to_timestamp, "DSQL_TOTIMESTAMP": _to_timestamp, "LAST_DAY": _plain(T.last_day, 1),
    "POSITION": _position, "SUBSTRING": _substring, "SUBSTR": _substring, "OVERLAY": _overlay,
    "LTRIM": _plain(lambda s, c: f"trim(LEADING {c} FROM {s})", 2), "RTRIM": _plain(lambda s, c: f"trim(TRAILING {c} FROM {s})", 2),
    "INITCAP": _plain(T.initcap, 1), "MOD": _plain(T.mod, 2), "ROUND": _plain(T.round_, 1, 2),
    "TRUNCATE": _plain(T.truncate, 1), "RAND_INTEGER": _plain(T.rand_integer, 1, 2),
    "MAX_BY": _by_extreme("max"), "MIN_BY": _by_extreme("min"),
    "SINGLE_VALUE": _plain(lambda x: f"first({x})", 1), "VARIANCEPOP": _plain(lambda x: f"var_pop({x})", 1),
    "LOCALTIME": _plain(lambda: "current_time()", 0), "$SUM0": _plain(lambda x: f"coalesce(sum({x}), 0)", 1),
}
#: Words that are calls without parentheses.
BARE = {"LOCALTIME": "current_time()", "LOCALTIMESTAMP": "localtimestamp()"}


#: Words that stand before an operand, not behind one.
_BEFORE = {"SELECT", "DISTINCT", "ALL", "WHERE", "AND", "OR", "NOT", "ON", "HAVING", "QUALIFY", "WHEN", "THEN", "ELSE", "CASE", "BY", "BETWEEN", "LIKE", "ILIKE", "RLIKE", "IN", "IS", "AS", "FROM", "TO", "FOR", "PLACING", "VALUES", "FILTER"}
#: Words that end a query's body.
_TAIL = {"ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "INTERSECT", "EXCEPT", "MINUS", "DISTRIBUTE", "CLUSTER", "SORT"}


def ends_operand(x: Token | Group) -> bool:
    return isinstance(x, Group) or x.kind in ("number", "literal", "string", "quoted", "tick") or x.kind == "word" and x.key not in _BEFORE or x.key == "]"


def operand_end(items: list, k: int) -> int:
    """Where the operand that begins at ``k`` ends: signs, then a name, literal, call, CASE or parentheses, and what hangs on it."""
    while k < len(items) and items[k].key in ("+", "-", "~"):
        k += 1
    if k >= len(items):
        return k
    if items[k].key == "CASE":
        depth = 0
        while k < len(items):
            depth += {"CASE": 1, "END": -1}.get(items[k].key, 0)
            k += 1
            if not depth:
                break
    elif items[k].key == "INTERVAL":
        k += 3
    elif items[k].key in ("DATE", "TIMESTAMP", "TIME") and k + 1 < len(items) and items[k + 1].kind in ("string", "literal"):
        k += 2
    else:
        k += 1
    while k < len(items):
        if isinstance(items[k], Group) and items[k - 1].kind in ("word", "tick"):
            k += 1
        elif items[k].key in (".", "::") and k + 1 < len(items):
            k += 2
        elif items[k].key == "[":
            while k < len(items) and items[k].key != "]":
                k += 1
            k += 1
        elif items[k].key in ("OVER", "FILTER") and k + 1 < len(items):
            k += 2
        else:
            break
    return min(k, len(items))


def operand_start(items: list, k: int) -> int:
    """Where the operand that ends before ``k`` begins, without a sign."""
    k -= 1
    while k > 1 and items[k - 1].key in ("OVER", "FILTER"):
        k -= 2
    if items[k].key == "END":
        depth = 0
        while k >= 0:
            depth += {"END": 1, "CASE": -1}.get(items[k].key, 0)
            if not depth:
                break
            k -= 1
        return k
    if items[k].key == "]":
        while k > 0 and items[k].key != "[":
            k -= 1
        k -= 1
    if isinstance(items[k], Group) and k and items[k - 1].kind in ("word", "tick") and items[k - 1].key not in _BEFORE:
        k -= 1
    while k > 1 and items[k - 1].key in (".", "::"):
        k -= 2
    return k


def _regular(group: Group) -> None:
    items, k = group.items, 1
    while k < len(items) - 1:
        key = items[k].key
        if key == "#":
            items[k] = Token("sign", "^")
        elif key in ("~", "!~", "~*", "!~*") and ends_operand(items[k - 1]):
            end = operand_end(items, k + 1)
            pattern = items[k + 1 : end]
            if key.endswith("*"):
                pattern = [Token("word", "concat"), Group([Token("literal", "'(?i)'"), Token("sign", ","), *pattern])]
            items[k:end] = [*([Token("word", "NOT")] if key[0] == "!" else []), Token("word", "RLIKE"), *pattern]
        k += 1


def _zero_divisors(group: Group) -> None:
    items, k = group.items, 1
    while k < len(items) - 1:
        if items[k].key in ("/", "%", "DIV") and ends_operand(items[k - 1]):
            end = operand_end(items, k + 1)
            divisor = items[k + 1 : end]
            if not (len(divisor) == 1 and divisor[0].kind == "number" and float(divisor[0].text)):
                items[k + 1 : end] = [Token("word", "nullif"), Group([*divisor, Token("sign", ","), Token("number", "0")], divisor=divisor)]
        k += 1


def _overs(items: list) -> Iterator[Group]:
    """Windows of this query, within calls too."""
    for k, x in enumerate(items):
        if isinstance(x, Group) and x.items and x.items[0].key not in ("SELECT", "WITH"):
            if k and items[k - 1].key == "OVER":
                yield x
            yield from _overs(x.items)


def _group_frames(group: Group) -> None:
    """``GROUPS`` counts groups of peers: a ``RANGE`` over their dense rank, which the table gets as a column."""
    items = group.items
    source = find(items, "FROM")
    found = [o for o in _overs(items[:source])] if source > 0 else []
    found = [o for o in found if any(x.key == "GROUPS" for x in o.items)]
    if not found:
        return
    body = min((k for k in range(source, len(items)) if items[k].key in _TAIL | {"WINDOW", "QUALIFY", "GROUP", "HAVING"}), default=len(items))
    where = min((k for k in range(source, body) if items[k].key == "WHERE"), default=body)
    table = items[source + 1 : where]
    if any(x.key in ("JOIN", ",") for x in table) or find(items, "GROUP", "BY") >= 0 or not table:
        raise ParsingException("GROUPS frames need a single table: put joins and groups into a subquery")
    ranks: list = []
    for k, over in enumerate(found):
        at, frame = find(over.items, "ORDER", "BY"), find(over.items, "GROUPS")
        if at < 0:
            raise ParsingException("GROUPS frames need ORDER BY")
        name = f"`__group{k}`"
        ranks += [Token("sign", ","), Token("word", "DENSE_RANK"), Group(), Token("word", "OVER"), Group(over.items[:frame]), Token("word", "AS"), Token("tick", name)]
        over.items[at:] = [Token("word", "ORDER"), Token("word", "BY"), Token("tick", name), Token("word", "RANGE"), *over.items[frame + 1 :]]
    inner = Group([Token("word", "SELECT"), Token("sign", "*"), *ranks, Token("word", "FROM"), *items[source + 1 : body]])
    alias = table[-1] if not isinstance(table[-1], Group) else Token("word", "t")
    items[source + 1 : body] = [inner, Token("word", "AS"), alias]


def _qualify(group: Group) -> None:
    """``SELECT a QUALIFY c`` filters what ``SELECT a, c`` gives."""
    items = group.items
    while (at := find(items, "QUALIFY")) >= 0:
        first = max(k for k in range(at) if items[k].key == "SELECT")
        source = find(items, "FROM", start=first)
        end = min((k for k in range(at, len(items)) if items[k].key in _TAIL), default=len(items))
        windows = find(items, "WINDOW", start=at)
        stop = windows if 0 < windows < end else end
        distinct = [items[first + 1]] if items[first + 1].key == "DISTINCT" else []
        listed, mark = items[first + 1 + len(distinct) : source], "`__qualify`"
        inner = Group([Token("word", "SELECT"), *listed, Token("sign", ","), Group(items[at + 1 : stop]), Token("word", "AS"), Token("tick", mark), *items[source:at], *items[stop:end]])
        outer = [Token("word", "SELECT"), *distinct, Token("sign", "*"), Token("word", "EXCEPT"), Group([Token("tick", mark)], done=True), Token("word", "FROM"), inner, Token("word", "WHERE"), Token("tick", mark)]
        items[first:end] = outer


def _right_semi(group: Group) -> None:
    """``a RIGHT SEMI JOIN b ON c`` is ``b LEFT SEMI JOIN a ON c``."""
    items = group.items
    for kind in ("SEMI", "ANTI"):
        while (at := find(items, "RIGHT", kind, "JOIN")) >= 0:
            first = 1 + max(k for k in range(at) if items[k].key in ("FROM", ","))
            on = min((k for k in range(at, len(items)) if items[k].key in ("ON", "USING")), default=len(items))
            left, right = items[first:at], items[at + 3 : on]
            joined = any(x.key == "JOIN" for x in left)
            items[first:on] = [*right, *(Token("word", w) for w in ("LEFT", kind, "JOIN")), *([Group(left)] if joined else left)]


def _aggregates(items: list) -> Iterator[tuple[Token, Group, bool]]:
    """Calls of this query, within calls too: name, arguments and whether a window follows."""
    for k, x in enumerate(items):
        if isinstance(x, Group) and x.items and x.items[0].key not in ("SELECT", "WITH"):
            if k and items[k - 1].kind == "word":
                after = k + 3 if k + 2 < len(items) and items[k + 1].key == "FILTER" else k + 1
                yield items[k - 1], x, after < len(items) and items[after].key == "OVER"
            yield from _aggregates(x.items)


def _distinct_sketches(group: Group) -> None:
    """Beside ``COUNT(DISTINCT y)`` Spark keeps the buffers of other aggregates for each y; a sketch of distinct values doesn't change
    if it takes each value once, and then it has one buffer for each group."""
    ends = [k for k, x in enumerate(group.items) if x.key in ("UNION", "INTERSECT", "EXCEPT", "MINUS")]
    for first, end in zip([0, *ends], [*ends, len(group.items)], strict=True):
        calls = [(name, args) for name, args, over in _aggregates(group.items[first:end]) if not over]
        if any(args.items[0].key == "DISTINCT" for _, args in calls):
            for name, args in calls:
                if name.key == "APPROX_COUNT_DISTINCT" and args.items[0].key not in ("DISTINCT", "ALL"):
                    args.items.insert(0, Token("word", "DISTINCT"))


def _similar(group: Group) -> None:
    while (at := find(group.items, "SIMILAR", "TO")) >= 0:
        pattern, size, escape = group.items[at + 2], 3, None
        if find(group.items, "ESCAPE", start=at + 3) == at + 3:
            escape, size = literal_value(group.items[at + 4]), 5
        if pattern.kind != "literal":
            end = operand_end(group.items, at + 2)
            if escape is not None or find(group.items, "ESCAPE", start=end) == end:
                raise ParsingException("SIMILAR TO with ESCAPE needs a literal pattern")
            group.items[at:end] = [Token("word", "RLIKE"), *fragment(T.similar_column(render(group.items[at + 2 : end])))]
            continue
        group.items[at : at + size] = [Token("word", "RLIKE"), Token("literal", quote(T.similar_pattern(literal_value(pattern), escape)))]


def _like_escape(group: Group) -> None:
    k = 0
    while k + 1 < len(group.items):
        if group.items[k].key in ("LIKE", "ILIKE") and group.items[k + 1].kind == "literal":
            escape = "\\"
            size = 2
            if find(group.items, "ESCAPE", start=k + 2) == k + 2:
                escape, size = literal_value(group.items[k + 3]), 4
            group.items[k + 1 : k + size] = [Token("literal", quote(T.like_pattern(literal_value(group.items[k + 1]), escape)))]
        k += 1


def _sample(group: Group) -> None:
    while (at := find(group.items, "TABLESAMPLE")) >= 0 and group.items[at + 1].key in ("SYSTEM", "BERNOULLI"):
        kind, share, size, seed = group.items[at + 1].key, render(group.items[at + 2].items), 3, None
        if find(group.items, "REPEATABLE", start=at + 3) == at + 3:
            seed, size = render(group.items[at + 4].items), 5
        if kind == "BERNOULLI":
            new = f"TABLESAMPLE ({share} PERCENT)" + (f" REPEATABLE ({seed})" if seed else "")
        else:
            new = ""
        name, alias, first = _sampled(group.items, at)
        if kind == "SYSTEM":
            # A part of a file, or of what isn't read from files a partition, is kept or not as a whole.
            unit = "input_file_name(), input_file_block_start(), CASE WHEN input_file_name() = '' THEN spark_partition_id() ELSE 0 END"
            where = f"pmod(xxhash64({unit}, {seed or 'uuid()'}), 1000000) < {share} * 10000"
            group.items[first : at + size] = [*_from(name, where), Token("word", "AS"), alias or name[-1]]
        else:
            group.items[first : at + size] = [*name, Token("word", "TABLESAMPLED"), *fragment(new)[1:], *([Token("word", "AS"), alias] if alias else [])]
    for x in group.items:
        if isinstance(x, Token) and x.text == "TABLESAMPLED":
            x.text = "TABLESAMPLE"


def _sampled(items: list, at: int) -> tuple[list, Token | None, int]:
    """Name and alias of the table before ``at``, and where they begin."""
    alias, end = None, at
    if at > 1 and items[at - 2].key == "AS":
        alias, end = items[at - 1], at - 2
    elif at > 1 and items[at - 2].kind in ("word", "tick") and items[at - 2].key not in ("FROM", "JOIN"):
        alias, end = items[at - 1], at - 1
    first = end - 1
    while first > 1 and items[first - 1].key == ".":
        first -= 2
    return items[first:end], alias, first


def _from(name: list, where: str) -> list:
    inner = Group([Token("word", "SELECT"), Token("sign", "*"), Token("word", "FROM"), *name, *fragment(f"WHERE {where}")])
    return [inner]


def _windows(group: Group) -> None:
    items = group.items
    for k in range(1, len(items)):
        if items[k].key == "OVER" and k + 1 < len(items) and isinstance(items[k + 1], Group):
            over = items[k + 1].items
            framed = any(x.key in ("ROWS", "RANGE", "GROUPS") for x in over)
            if isinstance(items[k - 1], Group) and items[k - 2].key == "FILTER":
                _filtered(items, k)
            f = k - 1
            while f > 0 and (items[f].kind == "literal" and not items[f].text or items[f].key in ("NULLS", "IGNORE", "RESPECT")):
                f -= 1
            if isinstance(items[f], Group):
                f -= 1
            if find(over, "ORDER", "BY") >= 0 and not framed and items[f].key not in FRAMELESS:
                over += fragment(FRAME)


def _filtered(items: list, k: int) -> None:
    """An aggregate with FILTER over a window: what doesn't pass becomes NULL."""
    condition, call = items[k - 1].items[1:], items[k - 3]
    case = [Token("word", "CASE"), Token("word", "WHEN"), Group(condition), Token("word", "THEN")]
    args = split(call.items)
    first = [Token("number", "1")] if len(args[0]) == 1 and args[0][0].key == "*" else args[0]
    rest = [x for part in args[1:] for x in [Token("sign", ","), *part]]
    call.items[:] = [*case, *first, Token("word", "END"), *rest]
    items[k - 2 : k] = [Token("literal", ""), Token("literal", "")]


def _order(group: Group) -> None:
    at = 0
    while (at := find(group.items, "ORDER", "BY", start=at)) >= 0:
        end = at + 2
        while end < len(group.items) and group.items[end].key not in ORDER_ENDS:
            end += 1
        out: list = []
        for k, part in enumerate(split(group.items[at + 2 : end])):
            if k:
                out.append(Token("sign", ","))
            out += part
            if part and part[-1].key not in ("FIRST", "LAST") and not (len(part) == 1 and part[0].key == "ALL"):
                out += [Token("word", "NULLS"), Token("word", "FIRST" if part[-1].key == "DESC" else "LAST")]
        group.items[at + 2 : end] = out
        at += 2 + len(out)
