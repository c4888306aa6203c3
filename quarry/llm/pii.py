"""Personal data: detection and keyed surrogates (DataFrame operations only).

Detected: e-mail addresses, phone numbers, IPv4 addresses, card numbers (with
a valid check digit), US social security numbers, IBANs, secrets behind a word that names
them, and person names behind a title or beginning with a known first name.

Each distinct entity (kind and canonical form) gets one surrogate of its kind
and format from a keyed hash: digits for digits, letters for letters of the
same case, hexadecimal for hexadecimal, a valid check digit for a card number,
the same country of a phone number or IBAN, a name of the same
gender and script.  The hash is HMAC-SHA256.  The same entity has the same surrogate everywhere; a name
is replaced word by word, so "Ms Ann Lee" and "Ann Lee" stay the same person,
and addresses at one domain stay at one domain, which no other domain comes to.

Collisions: two entities of a kind that come to one surrogate, or a surrogate
that is itself an entity found, are hashed again (all but the first in the
order of their hash) until there is none.  Where a format is too narrow for that,
surrogates grow by a sign a turn from the fourth turn on, as names do from the first.

Only what was found is moved, not texts: distinct texts with entities go by their
digest, the entities are reduced to distinct ones before they are checked, and the joins that a
frequent entity or a copied text makes hot have plain exchanges on both sides, which
adaptive execution splits.  Texts without entities pass straight through.

Defined results: null texts stay null, texts without entities stay as they
are; rows that repeat are treated alike; columns that the input has beside the
text, whatever their names, are carried along.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import materialize, quoted, released, without

# Words before a name, by gender where they tell it.
TITLES = {"m": ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Господин"), "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Госпожа"), "n": ("Dr", "Prof", "Professor", "Доктор")}
# Common first names.
FIRST_NAMES = {
    "m": ("James", "John", "Robert", "Michael", "William", "David", "Richard", "Joseph", "Thomas", "Charles", "Daniel", "Matthew", "Hans", "Jürgen", "Wolfgang", "Pierre", "Jacques", "François", "Carlos", "Miguel", "Javier", "Иван", "Сергей", "Дмитрий", "Алексей", "Николай"),
    "f": ("Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan", "Jessica", "Sarah", "Karen", "Emily", "Anna", "Ursula", "Ingrid", "Sabine", "Marie", "Camille", "Chloé", "María", "Carmen", "Lucía", "Анна", "Мария", "Елена", "Ольга", "Наталья"),
}
# Words that name a secret.
SECRET_WORDS = ("password", "passwd", "passwort", "secret", "token", "api[_-]?key", "access[_-]?key", "auth[_-]?key")



def _starts(words: tuple[str, ...] | list[str]) -> str:
    """The words as alternatives by first letter, behind a look at that letter, which most places fail."""
    letters = sorted({w[0] for w in words})
    return f"(?=[{''.join(letters)}])(?:" + "|".join(f"{c}(?:{'|'.join(sorted((w[1:] for w in words if w[0] == c), reverse=True))})" for c in letters) + ")"


# What a secret stands behind, and its value: to the closing quote, or a run of anything but white space,
# quotes and brackets, whose last sign is no comma and the like, up to the next named value.
_VALUE = r"(?:[^\s\"'<>,;&)\]}]++|[,;&)\]}](?=[^\s\"'<>])(?![A-Za-z_][A-Za-z0-9_-]{0,40}[\"']?[ \t]{0,3}[:=]))++"
_SOME = r"(?=[^\s\"'<>]*[\p{L}0-9])(?![0-9+(][0-9()-]* [0-9(]|[A-Z]{2}[0-9]{2} [A-Z0-9]{4})"  # not the head of a spaced number


def _secret(words: tuple[str, ...], equals: str, bare: str) -> str:
    quoted = r"(?:\"(?=[^\"\r\n]*[\p{L}0-9])[^\"\r\n]++(?=\"|\z)|'(?=[^'\r\n]*[\p{L}0-9])[^'\r\n]++(?='|\z))"
    return rf"(?i:(?<![a-z0-9])(?:{'|'.join(words)}))[\"']?[ \t]{{0,3}}(?:[:=][ \t]{{0,3}}{quoted}|=[ \t]{{0,3}}[\"']?{equals}{_VALUE}|:[ \t]{{0,3}}[\"']?{bare}{_VALUE})"


_LONG = r"(?=[A-Za-z0-9+/_.~-]{8})"
_SIGNED = rf"(?:{_LONG}|{_SOME}(?=[^\s\"'<>]*[0-9!#$%*+/@\\^_|~]))"
_SECRET = rf"(?=[PpSsTtAa])(?:{_secret(SECRET_WORDS[:3], f'(?:{_LONG}|{_SOME})', f'(?:{_LONG}|{_SOME})')}|{_secret(SECRET_WORDS[3:], f'(?:{_LONG}|{_SOME})', _SIGNED)})"
_SECRET_HEAD = r"^(?i:" + "|".join(SECRET_WORDS) + r")[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?"
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_either = lambda words: [*words, *(w.upper() for w in words)]  # noqa: E731  as it is and in capitals
_FIRST = _starts(_either([n for names in FIRST_NAMES.values() for n in names]))
_TITLE = _starts(_either([t for titles in TITLES.values() for t in titles]))
#: A further word of a name: no title, an initial only before another word.
_MORE = rf"(?: (?!{_TITLE}(?!\p{{L}}))(?:{_NAME}(?!\p{{L}})|\p{{Lu}}\.?(?= \p{{Lu}}[\p{{L}}'’-])))"
_INITIAL = r"^\p{Lu}\.?\s*$"
# Possessive: the stack that backtracking over labels takes would grow with their number.  Where the longest run of
# labels ends in no domain, a shorter one may.
_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\."
_TOP = r"[A-Za-z]{2,24}(?![A-Za-z0-9-])"
_EMAIL = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:(?:{_LABEL}(?=[A-Za-z0-9]))++{_TOP}|(?:{_LABEL}){{1,8}}{_TOP})"
#: What each kind looks like, most telling first.
PATTERNS = {
    "email": _EMAIL,
    "secret": _SECRET,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": r"(?<![0-9A-Za-z.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9A-Za-z]|\.[0-9])",
    # A whole run of digit groups; those that belong to an address or a word behind them are none of it.
    "card": r"(?<![0-9A-Za-z.])(?=(?:[0-9][ -]?){12}[0-9])[0-9]++(?:[ -][0-9]++(?![A-Za-z]|\.[0-9]{1,3}\.[0-9]|[A-Za-z0-9._%+-]{0,64}@))*+(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,5}\)[ .-]?|[0-9]{1,5}[ .-])[0-9]{2,4}[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4})?|\([0-9]{2,5}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}|[0-9]{3,5}[ .-][0-9]{3,4}[ .-][0-9]{4}|\+[0-9]{8,15})(?![0-9A-Za-z])",
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLE}\.?(?= ))(?: {_TITLE}\.?(?= ))*+{_MORE}++|{_FIRST}{_MORE}++)(?!\p{{L}})",
}
#: What may stand in a run of digits that is no card as a whole.
#: Three of a row of four or more groups of four are no phone number.
WITHIN = f"(?:{PATTERNS['ssn']})|(?!(?<=[0-9]{{4}}[ -])[0-9]{{4}}[ -][0-9]{{4}}[ -][0-9]{{4}}|[0-9]{{4}}(?: [0-9]{{4}}){{2}} [0-9]|[0-9]{{4}}(?:-[0-9]{{4}}){{2}}-[0-9])(?:{PATTERNS['phone']})"
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A part of whatever has an entity, far cheaper to look for: an at sign, digits in a row, an IBAN's head, a sign behind a word that may name a secret, the head of a name.
HINT = r"@[A-Za-z0-9]|[0-9][0-9 .()-]{6}|[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}|[:=](?<=[DdTtNnYy][\"']?[ \t]{0,3}[:=])"
NAME_HINT = rf"(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_FIRST})\.? \p{{Lu}}"

_LATIN = ("bdfghklmnprstvwz", "aeiou")
_CYRILLIC = ("бвгдзклмнпрстфхч", "аеиоу")


def _digits(raw: Column) -> Column:
    return F.regexp_replace(raw, "[^0-9]", "")


def _byte(stream: Column, at: Column) -> Column:
    return F.conv(F.substring(stream, 2 * (at % 128) + 1, F.lit(2)), 16, 10).cast("int")


def _letter(letters: str, number: Column) -> Column:
    return F.substring(F.lit(letters), number % len(letters) + 1, F.lit(1))


def _mac(key: str, *parts: Column) -> Column:
    """HMAC-SHA256 of the parts, in hexadecimal."""
    own = key.encode("utf-8")
    own = (hashlib.sha256(own).digest() if len(own) > 64 else own).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in own)) for x in (0x36, 0x5C))
    said = F.encode(F.concat_ws("\x1f", *[p.cast("string") for p in parts]), "utf-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, said), 256))), 256)


def _stream(key: str, *parts: Column) -> Column:
    """128 bytes in hexadecimal, from the key and the parts."""
    return F.concat(*[_mac(key, F.lit(k), *parts) for k in "0123"])


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _shaped(text: Column, stream: Column) -> Column:
    """Digits for digits, letters for letters of their case (hexadecimal if all are); signs stay."""
    hexadecimal = text.rlike("^[0-9a-f]+$") | text.rlike("^[0-9A-F]+$")

    def one(c: Column, b: Column, span: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), F.char(48 + b % 10)).when(c.rlike("^[a-z]$"), F.char(97 + b % span)).when(c.rlike("^[A-Z]$"), F.char(65 + b % span)).when(c.rlike(r"^\p{L}$"), F.char(97 + b % 26)).otherwise(c)

    return _let(F.when(hexadecimal, F.lit(6)).otherwise(F.lit(26)), lambda span: F.array_join(F.transform(F.split(text, ""), lambda c, i: one(c, _byte(stream, i), span)), ""))


def _luhn(digits: Column) -> Column:
    """Sum modulo 10 of the Luhn scheme; 0 for a valid number."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    summed = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.try_cast("int"))).otherwise(c.try_cast("int"))), F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))
    )
    return summed % 10


def _syllables(letters: tuple[str, str], stream: Column, first: int, last: Column) -> Column:
    """A made-up word: pairs of consonant and vowel up to byte ``last``."""
    pair = lambda i: F.concat(_letter(letters[0], _byte(stream, 2 * i)), _letter(letters[1], _byte(stream, 2 * i + 1)))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(first), last), pair), ""))


#: The turn from which surrogates grow by a sign a turn.
WIDEN = 4


def surrogate(key: str, kind: Column, canon: Column, turn: Column) -> Column:
    """The surrogate of an entity at its ``turn``-th hash, in canonical form."""
    return _let(_stream(key, kind, canon, turn), lambda stream: _made(stream, kind, canon, turn))


def _made(stream: Column, kind: Column, canon: Column, turn: Column) -> Column:
    wide = F.greatest(turn.cast("int") - (WIDEN - 1), F.lit(0))  # signs beyond the own format, where that is too narrow
    longer = F.repeat(F.lit("x"), wide)
    local, domain = F.substring_index(canon, "@", 1), F.substring_index(canon, "@", -1)
    name = F.regexp_replace(canon, r"\.[^.]*$", "")
    # A mailbox is told apart within its domain, which has a surrogate of its own.
    email = F.concat(_shaped(F.concat(local, longer), stream), F.lit("@"), domain)
    host = F.concat(_shaped(F.concat(name, longer), stream), F.lit(".example"))
    canon = F.when(kind.isin("card", "phone", "iban", "ssn"), F.concat(canon, F.repeat(F.lit("0"), wide))).when(kind == "secret", F.concat(canon, longer)).otherwise(canon)
    body = lambda keep: F.concat(F.substring(canon, F.lit(1), keep), _shaped(F.substr(canon, keep + 1), stream))
    changed = body(F.lit(1))
    check = F.substring(changed, F.lit(1), F.length(changed) - 1)
    card = F.concat(check, ((10 - _luhn(F.concat(check, F.lit("0")))) % 10).cast("string"))
    # Private addresses, and reserved ones when those run short.
    ip = F.concat_ws(".", F.when(turn < 4, F.lit(10)).otherwise(240 + _byte(stream, F.lit(3)) % 15).cast("string"), *[_byte(stream, F.lit(k)).cast("string") for k in range(3)])
    more = (2 + turn).cast("int")  # names grow as turns go on
    word = F.when(kind.endswith("cyrillic"), _syllables(_CYRILLIC, stream, 0, more)).otherwise(_syllables(_LATIN, stream, 0, more))
    female, cyrillic = kind.contains(":f:"), kind.endswith("cyrillic")
    end = (
        F.when(kind.startswith("first"), F.when(cyrillic, F.when(female, "на").otherwise("н")).otherwise(F.when(female, "na").otherwise("n")))
        .otherwise(F.when(cyrillic, F.when(female, "ева").otherwise("ев")).otherwise("son"))
    )
    return (
        F.when(kind == "email", email).when(kind == "host", host).when(kind == "ip", ip).when(kind == "card", card)
        .when(kind == "phone", body(F.when(canon.startswith("+"), F.lit(2)).otherwise(F.lit(0))))
        .when(kind == "iban", body(F.lit(2))).when(kind == "ssn", F.concat(F.lit("9"), F.substr(body(F.lit(0)), F.lit(2))))
        .when(kind.rlike("^(first|last):"), F.concat(word, end)).otherwise(body(F.lit(0)))
    )


def _kind(raw: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        here = raw.rlike(f"^(?:{pattern})$")
        if kind == "card":  # a long number without a valid check digit is no card
            here = here & _is_card(raw)
        out = F.when(here, kind) if out is None else out.when(here, kind)
    return out.otherwise("number")


def _is_card(raw: Column) -> Column:
    return F.length(_digits(raw)).between(13, 19) & (_luhn(_digits(raw)) == 0)


def _part(kind: Column, raw: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), raw.alias("raw"))


def _cards(raw: Column, strict: bool) -> Column:
    """Parts of a run of digit groups: the longest valid cards from the left, and what stands between.

    A card begins with a group of four digits or more.  ``strict``: groups that a hyphen
    ties to others are no part of a card written with spaces.
    """
    nothing = F.lit(None).cast("string")
    groups = F.regexp_extract_all(raw, F.lit(r"[0-9]+[ -]?|[ -]"), F.lit(0))
    start = F.struct(F.array().cast("array<struct<kind:string,raw:string>>").alias("done"), F.lit("").alias("rest"), F.lit(0).alias("next"), F.lit(0).alias("at"))

    def step(s: Column, group: Column) -> Column:
        most = F.least(F.lit(19), F.size(groups) - s["at"])
        from_here = lambda k: F.array_join(F.slice(groups, s["at"] + 1, k), "")
        bare = lambda k: F.regexp_replace(from_here(k), "[ -]$", "")

        def fits(k: Column) -> Column:
            ok = _is_card(bare(k))
            if strict:
                tied = s["rest"].endswith("-") | (from_here(k).endswith("-") & (s["at"] + k < F.size(groups)))
                ok = ok & ~(bare(k).contains(" ") & (tied | bare(k).contains("-")))
            return ok

        longest = F.array_max(F.filter(F.sequence(F.lit(1), most), fits))
        n = F.when((s["at"] >= s["next"]) & group.rlike("^[0-9]{4}"), longest)
        sign = F.regexp_extract(from_here(n), "[ -]$", 0)
        plain = F.when(s["rest"] == "", F.array().cast("array<struct<kind:string,raw:string>>")).otherwise(F.array(_part(nothing, s["rest"])))
        return (
            F.when(s["at"] < s["next"], F.struct(s["done"].alias("done"), s["rest"].alias("rest"), s["next"].alias("next"), (s["at"] + 1).alias("at")))
            .when(n.isNotNull(), F.struct(F.concat(s["done"], plain, F.array(_part(F.lit("card"), bare(n)))).alias("done"), sign.alias("rest"), (s["at"] + n).cast("int").alias("next"), (s["at"] + 1).alias("at")))
            .otherwise(F.struct(s["done"].alias("done"), F.concat(s["rest"], group).alias("rest"), s["next"].alias("next"), (s["at"] + 1).alias("at")))
        )

    return F.aggregate(groups, start, step, lambda s: F.concat(s["done"], F.array(_part(nothing, s["rest"]))))


def _run(raw: Column) -> Column:
    """Parts of a run of digits that is no card as a whole: cards, then other numbers of persons in what is left."""
    nothing = F.lit(None).cast("string")
    inner = lambda parts, f: F.flatten(F.transform(parts, lambda p: F.when(p["kind"].isNull(), f(p["raw"])).otherwise(F.array(p))))

    def others(rest: Column) -> Column:
        found = F.regexp_extract_all(rest, F.lit(WITHIN), F.lit(0))
        kind = lambda r: F.when(r.rlike(f"^(?:{PATTERNS['ssn']})$"), "ssn").otherwise("phone")
        both = lambda t, i: F.when(i < F.size(found), F.array(_part(nothing, t), _part(kind(F.get(found, i)), F.get(found, i)))).otherwise(F.array(_part(nothing, t)))
        return F.flatten(F.transform(F.split(rest, WITHIN, -1), both))

    return inner(inner(_cards(raw, True), lambda r: _cards(r, False)), others)


def _units(raw: Column, kind: Column) -> Column:
    """Parts ``kind, raw`` of a match that are replaced one by one; a part of kind null stays."""
    part = _part
    nothing = F.lit(None).cast("string")
    words = F.regexp_extract_all(raw, F.lit(r"\S+\s*"), F.lit(0))
    bare = lambda w: F.regexp_replace(w, r"[.\s]+$", "")
    of = lambda w, names: bare(w).isin(*_either(names))
    head = F.element_at(words, 1)
    gender = F.when(of(head, TITLES["m"] + FIRST_NAMES["m"]), "m").when(of(head, TITLES["f"] + FIRST_NAMES["f"]), "f").otherwise("n")
    titles = F.size(F.filter(words, lambda w: of(w, [t for titles in TITLES.values() for t in titles])))
    script = F.when(raw.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    given = lambda w: F.when(of(w, FIRST_NAMES["m"]), "m").when(of(w, FIRST_NAMES["f"]), "f")

    def one(w: Column, i: Column) -> Column:
        own = F.coalesce(given(w), gender)
        at, last_at = i - titles, F.size(words) - titles - 1
        # Given names and initials before the last word; other words between may be surnames too.
        first = ((at == 0) & ((last_at > 0) | given(w).isNotNull())) | ((at < last_at) & (given(w).isNotNull() | w.rlike(_INITIAL)))
        # A surname is the same entity whoever bears it, but its ending follows the script's gender.
        last = F.concat(F.lit("last:"), F.when(script == "cyrillic", gender).otherwise("n"), F.lit(":"), script)
        return part(F.when(at < 0, nothing).when(first, F.concat(F.lit("first:"), own, F.lit(":"), script)).otherwise(last), w)

    head = F.regexp_extract(raw, _SECRET_HEAD, 0)
    secret = F.array(part(nothing, head), part(F.lit("secret"), F.substr(raw, F.length(head) + 1)))
    address = F.array(part(F.lit("email"), raw), part(nothing, F.lit("@")), part(F.lit("host"), F.substring_index(raw, "@", -1)))
    return F.when(kind == "name", F.transform(words, one)).when(kind == "email", address).when(kind == "secret", secret).when((kind == "number") & raw.rlike("^[0-9][0-9 -]*$"), _run(raw)).otherwise(F.array(part(F.when(kind != "number", kind), raw)))


def _canon(kind: Column, raw: Column) -> Column:
    return (
        F.when(kind.isin("email", "host"), F.lower(raw)).when(kind.isin("card", "ssn"), _digits(raw))
        .when(kind == "phone", F.concat(F.when(raw.startswith("+"), "+").otherwise(""), _digits(raw)))
        .when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind.rlike("^(first|last):"), F.lower(F.trim(F.regexp_replace(raw, r"\.\s*$", "")))).otherwise(raw)
    )


def _formatted(kind: Column, raw: Column, made: Column) -> Column:
    """The surrogate in the form that the entity had at this place."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("next"))

    def fill(signs: str):
        def step(s: Column, c: Column) -> Column:
            own = c.rlike(signs)
            return F.struct(F.concat(s["text"], F.when(own, F.substring(made, s["next"], F.lit(1))).otherwise(c)).alias("text"), F.when(own, s["next"] + 1).otherwise(s["next"]).alias("next"))

        return F.aggregate(F.split(raw, ""), start, step, lambda s: F.concat(s["text"], F.substr(made, s["next"])))  # what a wider one has more

    capitals = (raw == F.upper(raw)) & (F.length(F.trim(raw)) > 1) & ~raw.rlike(_INITIAL)
    shown = F.substring_index(made, "@", 1)  # of an address its mailbox; the host follows as a part of its own
    name = F.concat(F.when(capitals, F.upper(made)).otherwise(made), F.regexp_extract(raw, r"\s*$", 0))
    return (
        F.when(made.isNull(), raw).when(kind.isin("card", "ssn"), fill("[0-9]")).when(kind == "phone", fill("[0-9+]")).when(kind == "iban", fill("[A-Z0-9]"))
        .when(kind.rlike("^(first|last):"), name).when(kind.isin("email", "host"), F.when(capitals, F.upper(shown)).otherwise(shown)).otherwise(made)
    )


def assign(entities: DataFrame, key: str, turns: int = 64) -> DataFrame:
    """``kind, canon, made`` for distinct ``kind, canon``: distinct surrogates, none of them an entity."""
    family = F.regexp_replace("kind", ":.*", "")
    now = materialize(entities.select("kind", "canon", F.lit(0).alias("turn"), surrogate(key, F.col("kind"), F.col("canon"), F.lit(0)).alias("made")))
    for turn in range(1, turns + 1):
        rank = _mac(key, F.col("kind"), F.col("canon"))
        first = now.groupBy(family.alias("f"), "made").agg(F.min(rank).alias("least"), F.count(F.lit(1)).alias("n"))
        clash = first.where("n > 1").select("f", F.col("made").alias("m"), "least")
        real = now.select(family.alias("f"), F.col("canon").alias("m")).distinct().withColumn("real", F.lit(True))
        made = F.when(family.isin("first", "last"), F.lower("made")).otherwise(F.col("made"))
        marked = (
            now.withColumn("own", family)
            .join(clash, (F.col("own") == F.col("f")) & (F.col("made") == F.col("m")), "left").drop("f", "m")
            .join(real, (F.col("own") == F.col("f")) & (made == F.col("m")), "left")
        )
        again = (F.col("least").isNotNull() & (rank != F.col("least"))) | F.col("real").isNotNull()
        marked = materialize(marked.select("kind", "canon", "turn", "made", again.alias("again")))
        if marked.where("again").isEmpty():
            return marked.select("kind", "canon", "made")
        now = materialize(marked.select("kind", "canon", F.when(F.col("again"), F.lit(turn)).otherwise(F.col("turn")).alias("turn"), F.when(F.col("again"), surrogate(key, F.col("kind"), F.col("canon"), F.lit(turn))).otherwise(F.col("made")).alias("made")))
    raise ValueError(f"{turns} hashes leave surrogates that collide")


def _hinted(text: str) -> Column:
    return F.col(text).rlike(HINT) | F.col(text).rlike(NAME_HINT)


def found_in(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """``digest, place, raw, kind, unit, part`` - each part of each entity, once for each distinct text."""
    texts = docs.where(_hinted(text)).select(F.unhex(F.sha2(text, 256)).alias("digest"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)).alias("found"))
    once = texts.where(F.size("found") > 0).dropDuplicates(["digest"])
    matches = once.select("digest", F.posexplode("found").alias("place", "raw")).withColumn("kind", _kind(F.col("raw")))
    return matches.select("digest", "place", "raw", "kind", F.posexplode(_units(F.col("raw"), F.col("kind"))).alias("unit", "part"))


def surrogates(docs: DataFrame, key: str, *, text: str = "text", count: str = "n_entities", kinds: str = "kinds") -> DataFrame:
    """``docs`` with the text replaced, ``count`` and ``kinds`` (``kind: number`` by kind, as a map).

    Columns that bear the names of these two, in any case, give way.
    """
    own = {c: f"_{uuid.uuid4().hex}_{c}" for c in ("digest", "found")}
    parts = materialize(found_in(docs, text=text).select("digest", "place", F.when(F.col("kind") == "number", F.coalesce("part.kind", "kind")).otherwise(F.col("kind")).alias("of"), ((F.col("unit") == 0) | (F.col("kind") == "number")).alias("head"), "unit", "part.kind", "part.raw").withColumn("canon", _canon(F.col("kind"), F.col("raw"))))
    made = assign(parts.where("kind is not null").select("kind", "canon").distinct(), key)
    told = made.select(F.col("kind").alias("k"), F.col("canon").alias("c"), "made")
    shown = parts.join(told, (F.col("kind") == F.col("k")) & (F.col("canon") == F.col("c")), "left").select("digest", "place", "of", "head", "unit", _formatted(F.col("kind"), F.col("raw"), F.col("made")).alias("shown"))
    # Places of a text count from zero without a gap, so that each is looked up by its number.
    units = F.array_sort(F.collect_list(F.struct("unit", "shown")))
    by_place = shown.groupBy("digest", "place").agg(F.array_join(F.transform(units, lambda x: x["shown"]), "").alias("shown"), F.collect_list(F.when(F.col("head") & (F.col("of") != "number"), F.col("of"))).alias("heads"))
    listed = F.array_sort(F.collect_list(F.struct("place", "shown", "heads")))
    by_text = materialize(by_place.groupBy("digest").agg(listed.alias("found")).select(F.col("digest").alias(own["digest"]), F.col("found").alias(own["found"])))
    released(parts)

    has = F.coalesce(_hinted(text), F.lit(False))
    hit = docs.where(has).withColumn(f"{own['digest']}_text", F.unhex(F.sha2(text, 256))).join(by_text, F.col(f"{own['digest']}_text") == F.col(own["digest"]), "left")
    found = F.col(own["found"])
    whole = F.array_join(F.transform(F.split(F.col(text), ANY, -1), lambda s, i: F.concat(s, F.coalesce(F.get(found, i)["shown"], F.lit("")))), "")
    heads = F.flatten(F.transform(found, lambda x: x["heads"]))
    new = F.when(found.isNull(), F.col(text)).otherwise(whole)
    by_kind = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(heads)), lambda k: F.struct(k, F.size(F.filter(heads, lambda x: x == k)))))
    nothing = F.create_map().cast("map<string,int>")
    names = without(docs.columns, count, kinds)
    changed = hit.select(*[new.alias(c) if c == text else F.col(quoted([c])[0]) for c in names], F.coalesce(F.size(heads), F.lit(0)).alias(count), F.coalesce(by_kind, nothing).alias(kinds))
    clean = docs.where(~has).select(*quoted(names), F.lit(0).alias(count), nothing.alias(kinds))
    return changed.unionByName(clean)
