"""Spark SQL text for functions that Spark lacks or reads differently."""

from __future__ import annotations

import re

_INTEGERS = "('tinyint', 'smallint', 'int', 'bigint')"
_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"
UNITS = ("YEAR", "QUARTER", "MONTH", "WEEK", "DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND", "NANOSECOND")


def unit_name(text: str) -> str:
    unit = text.strip("'").upper().removeprefix("SQL_TSI_")
    unit = {"FRAC_SECOND": "MICROSECOND"}.get(unit, unit)
    unit = unit[:-1] if unit.endswith("S") else unit
    if unit not in UNITS:
        raise NotImplementedError(f"time unit {text}")
    return unit


def moment(x: str) -> str:
    """A time stamp without zone; integers are seconds since 1970."""
    return f"CASE WHEN typeof({x}) IN {_INTEGERS} THEN {_EPOCH} + make_dt_interval(0, 0, 0, try_cast(CAST({x} AS STRING) AS BIGINT)) ELSE try_cast(CAST({x} AS STRING) AS TIMESTAMP_NTZ) END"


def extract(field: str, x: str) -> str:
    name = field.upper()
    name = name[:-1] if name.endswith("S") and name not in ("DOS",) else name
    micro = f"CAST(date_format({x}, 'SSSSSS') AS INT)"
    made = {
        "CENTURY": f"(year({x}) div 100)",
        "DECADE": f"(year({x}) div 10)",
        "MILLENNIUM": f"(year({x}) div 1000)",
        "DOW": f"(dayofweek({x}) - 1)",
        "DOY": f"dayofyear({x})",
        "WEEK": f"weekofyear({x})",
        "SECOND": f"second({x})",
        "MICROSECOND": micro,
        "MILLISECOND": f"(1000 * {micro})",
        "DATE": f"to_date({x})",
        "EPOCH": f"timestampdiff(SECOND, {_EPOCH}, {x})",
    }
    return made.get(name) or f"extract({name} FROM {x})"


def timestamp_add(unit: str, n: str, x: str) -> str:
    if n.replace(" ", "").startswith("-") and re.fullmatch(r"-\s*\d+", n):
        raise RuntimeError("a negative interval isn't supported")
    return f"timestampadd({unit}, {n}, {moment(x)})"


def timestamp_diff(unit: str, a: str, b: str) -> str:
    if unit == "NANOSECOND":
        return f"(1000 * timestampdiff(MICROSECOND, {a}, {b}))"
    return f"timestampdiff({unit}, {a}, {b})"


def by_unit(kind: str, x: str, unit: str) -> str:
    unit = unit_name(unit)
    if unit not in ("DAY", "HOUR", "MINUTE", "SECOND", "MILLISECOND", "MICROSECOND"):
        raise NotImplementedError(f"{kind} to {unit}")
    down = f"CAST(date_trunc('{unit}', {x}) AS TIMESTAMP_NTZ)"
    if kind == "floor":
        return down
    return f"CASE WHEN CAST({x} AS TIMESTAMP_NTZ) = {down} THEN {down} ELSE timestampadd({unit}, 1, {down}) END"


def last_day(x: str) -> str:
    """End of the month; the time of day stays."""
    return f"(CAST(last_day({x}) AS TIMESTAMP_NTZ) + (CAST({x} AS TIMESTAMP_NTZ) - CAST(to_date({x}) AS TIMESTAMP_NTZ)))"


# Strptime fields and Spark's pattern letters.
STRPTIME = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%p": "a", "%j": "DDD", "%a": "E", "%A": "EEEE", "%%": "%"}


def java_pattern(form: str) -> str:
    out = []
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", form):
        if part[0] == "%":
            if part not in STRPTIME:
                raise NotImplementedError(f"time format {part}")
            out.append(STRPTIME[part])
        else:
            out.append("'" + part + "'" if part[0].isalpha() else part)
    return "".join(out)


def to_timestamp(x: str, form: str | None) -> str:
    if form and re.fullmatch(r"-?\d+", x):
        raise RuntimeError("an integer can't be parsed by a format")
    if form is None:
        return f"({moment(x)})"
    pattern = java_pattern(form).replace("'", "''")
    return f"to_timestamp_ntz(CAST({x} AS STRING), '{pattern}')"


def position(x: str, s: str, start: str | None = None) -> str:
    return f"locate({x}, {s}, {start})" if start else f"locate({x}, {s})"


def substring(s: str, start: str, n: str | None = None) -> str:
    return f"substring({s}, greatest({start}, 1)" + (f", {n})" if n else ")")


def overlay(s: str, new: str, start: str, n: str | None = None) -> str:
    return f"overlay({s} PLACING {new} FROM greatest({start}, 1)" + (f" FOR {n})" if n else ")")


def initcap(s: str) -> str:
    """Upper case after anything that isn't a letter, lower case else."""
    return f"array_join(transform(regexp_extract_all({s}, '\\\\p{{L}}+|\\\\P{{L}}+', 0), w -> concat(upper(left(w, 1)), lower(substring(w, 2)))), '')"


def mod(a: str, b: str) -> str:
    """The sign of the divisor; NULL for zero."""
    divisor = f"({b})" if re.fullmatch(r"\s*-?\s*[0-9.]*[1-9][0-9.]*", b) else f"nullif({b}, 0)"
    return f"(({a}) - floor(({a}) / {divisor}) * ({b}))"


def round_(x: str, n: str = "0") -> str:
    """Half to even."""
    return f"CAST(bround({x}, {n}) AS DOUBLE)"


def truncate(x: str) -> str:
    return f"CAST(CASE WHEN ({x}) < 0 THEN ceil({x}) ELSE floor({x}) END AS DOUBLE)"


def by_extreme(kind: str, x: str, y: str) -> str:
    """The least ``x`` of those with the extreme ``y``, in whatever order rows come; numbers as numbers, others by their text, NULL last."""
    kinds = f"typeof({x})"
    whole = f"CASE WHEN {kinds} IN {_INTEGERS} THEN try_cast(CAST({x} AS STRING) AS BIGINT) END"
    real = f"CASE WHEN {kinds} IN ('float', 'double') OR {kinds} LIKE 'decimal%' THEN try_cast(CAST({x} AS STRING) AS DOUBLE) END"
    text = f"CASE WHEN {kinds} NOT IN {_INTEGERS} THEN hex(CAST({x} AS STRING)) END"
    if kind == "max":  # what is least comes out greatest
        whole, real, text = f"~({whole})", f"-({real})", f"concat(translate({text}, '0123456789ABCDEF', 'FEDCBA9876543210'), 'G')"
    return f"{kind}_by({x}, CASE WHEN ({y}) IS NOT NULL THEN struct({y}, ({x}) IS {'NOT ' if kind == 'max' else ''}NULL, {whole}, {real}, {text}) END)"


def ceil(x: str) -> str:
    return f"CAST(ceil({x}) AS DOUBLE)"


def floor(x: str) -> str:
    return f"CAST(floor({x}) AS DOUBLE)"


def rand_integer(a: str, b: str | None = None) -> str:
    return f"CAST(floor(rand({a}) * ({b})) AS BIGINT)" if b else f"CAST(floor(rand() * ({a})) AS BIGINT)"


def like_pattern(pattern: str, escape: str) -> str:
    """The pattern with a backslash before what is meant literally, and only there."""
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append("\\" + pattern[k] if pattern[k] in "%_\\" else pattern[k])
        else:
            out.append("\\\\" if c == "\\" else c)
        k += 1
    return "".join(out)


def similar_pattern(pattern: str, escape: str | None = None) -> str:
    """A regular expression: % and _ are wild, classes and alternatives stay, other signs are literal."""
    escape = escape or "\\"
    out, k = [], 0
    while k < len(pattern):
        c = pattern[k]
        if c == escape and k + 1 < len(pattern):
            k += 1
            out.append(re.escape(pattern[k]))
        elif c == "%":
            out.append(".*")
        elif c == "_":
            out.append(".")
        elif c in "#$^.~-" and not _in_class(pattern, k):
            out.append("\\" + c)
        else:
            out.append(c)
        k += 1
    return "(?s)\\A(?:^" + "".join(out) + "$)"


def similar_column(pattern: str) -> str:
    """The regular expression of a pattern that is only known at run time; signs within a class aren't told apart."""
    plain = f"regexp_replace({pattern}, '([#$^.~])', '\\\\\\\\$1')"
    return f"concat('(?s)\\\\A(?:^', replace(replace({plain}, '%', '.*'), '_', '.'), '$)')"


def _in_class(pattern: str, k: int) -> bool:
    return pattern.rfind("[", 0, k) > pattern.rfind("]", 0, k)
