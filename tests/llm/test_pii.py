import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import pii

ROWS = [
    (1, "Write to Ann.Lee@corp.com or +1 (555) 123-4567, card 4111 1111 1111 1111, ip 8.8.8.8."),
    (2, 'ANN.LEE@CORP.COM, again +1-555-123-4567; SSN 123-45-6789; token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x'),
    (3, None),
    (4, ""),
    (5, "Mr. John Smith met Mary Smith and Frau Müller. Госпожа Анна Петрова; MARY"),
    (6, "Version 2.0 of 2024-01-02, 1,000,000 and 3.14159 at 300.1.2.3, no. 1234567812345678, Sra. of 12 345 678 and 1 234 567 890"),
    (7, "4111-1111-1111-1111 DE89 3704 0044 0532 0130 00, bob@corp.com"),
    (8, "Mr. John Smith met Mary Smith and Frau Müller. Госпожа Анна Петрова; MARY"),
    (8, "8.8.8.8"),
    (None, "8.8.8.8 8.8.4.4"),
    (9, "filler " * 100_000 + "x@y.org"),
]


@pytest.fixture(scope="module")
def done(spark):
    docs = spark.createDataFrame(ROWS, "doc_id bigint, text string").selectExpr("*", "'k' as kind", "1 as digest", "2 as place", "3 as `found`").repartition(4)
    got = pii.surrogates(docs, "a key")
    assert got.columns == [*docs.columns, "n_entities", "kinds"]
    return got.collect()


def by_id(done, i):
    return [r for r in done if r.doc_id == i]


def luhn(number):
    digits = [int(c) for c in reversed(re.sub(r"\D", "", number))]
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)) % 10 == 0


def test_each_kind_keeps_its_format(done):
    one = by_id(done, 1)[0]
    m = re.fullmatch(r"Write to ([a-z]{3}\.[a-z]{3}@[a-z]{4}\.example) or \+1 \((\d{3})\) (\d{3})-(\d{4}), card (4\d{3} \d{4} \d{4} \d{4}), ip (10\.\d+\.\d+\.\d+)\.", one.text)
    assert m and luhn(m[5]) and one.kinds == {"email": 1, "phone": 1, "card": 1, "ip": 1} and one.n_entities == 4
    two = by_id(done, 2)[0].text
    assert m[1].upper() in two and f"+1-{m[2]}-{m[3]}-{m[4]}" in two and re.search(r'SSN 9\d\d-\d\d-\d{4}; token = "[0-9a-f]{40}" x', two)
    seven = by_id(done, 7)[0].text
    assert seven.startswith(m[5].replace(" ", "-")) and re.search(r" DE\d\d( \d{4}){4} \d\d, ", seven)
    assert seven.rpartition("@")[2] == m[1].rpartition("@")[2]  # one domain stays one domain


def test_nothing_that_was_found_is_left(done):
    text = "\n".join(r.text or "" for r in done)
    for old in ("corp.com", "123-4567", "1111", "8.8.8.8", "8.8.4.4", "123-45-6789", "04dbebab", "John", "Smith", "Mary ", "Müller", "Петров", "x@y.org", "3704"):
        assert old.lower() not in text.lower(), old


def test_names_keep_person_gender_and_script(done):
    a, b = by_id(done, 5)[0], [r for r in by_id(done, 8) if "Mr" in r.text][0]
    assert a.text == b.text
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met (\w+) (\w+) and Frau (\w+)\. Госпожа ([А-Я][а-я]+) ([А-Я][а-я]+); MARY", a.text)
    assert m and m[2] == m[4] != m[5] and m[1] != m[3] and m[3].endswith("na") and m[6].endswith("на") and m[7].endswith("ева")


def test_clean_texts_stay(done):
    assert {r.doc_id: r.text for r in done if r.n_entities == 0} == {3: None, 4: "", 6: ROWS[5][1]}
    assert by_id(done, 9)[0].text.startswith("filler " * 100_000) and len(done) == len(ROWS)


def test_keyed_and_repeatable(spark, done):
    docs = spark.createDataFrame(ROWS[:2], "doc_id bigint, text string")
    assert {r.text for r in pii.surrogates(docs, "a key").collect()} == {r.text for r in done if r.doc_id in (1, 2)}
    assert not {r.text for r in pii.surrogates(docs, "another").collect()} & {r.text for r in done}


def test_collisions_are_resolved(spark):
    entities = [("ip", f"9.9.{k // 250}.{k % 250}") for k in range(2000)] + [("ssn", f"{k:09d}") for k in range(3000)]
    entities += [("first:f:latin", f"name{k}") for k in range(3000)]
    got = pii.assign(spark.createDataFrame(entities, "kind string, canon string"), "k").collect()
    assert len(got) == len(entities) and len({(r.kind, r.made) for r in got}) == len(entities)
    assert not {r.made.lower() for r in got} & {c for _, c in entities}
    few = spark.createDataFrame([("iban", f"DE{k}") for k in range(7)], "kind string, canon string")
    with pytest.raises(ValueError, match="collide"):  # seven others of this form don't exist
        pii.assign(few, "k", turns=2)


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.surrogates(docs, "k").count() == 0


def test_hints_miss_nothing(spark):
    """Whatever a pattern finds, a hint finds too."""
    found = [
        "a@b.co", "x.y-z%1@a-b.example.org", "password: hunter2hunter2", "API-KEY='abcdefgh'", "token\" : \"abcdefgh\"", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "123-45-6789", "1.1.1.1", "255.255.255.255",
        "4111111111111111", "4111 1111 1111 1111", "+14155550123", "+49 30 123 4567", "(12)345-678", "(030) 1234 5678", "+1 (555) 123-4567", "555.123.4567", "Mr. Lee", "Herr Müller", "Anna Karenina", "Иван Петров", "Señora Ruiz", "Dr Who Mann",
    ]
    rows = spark.createDataFrame([(f"so {t}, and",) for t in found], "text string")
    got = rows.select("text", pii._hinted("text").alias("hint"), F.expr("text").rlike(pii.ANY).alias("any")).collect()
    assert [r.text for r in got if not r["any"]] == [] and [r.text for r in got if not r.hint] == []
    assert set(pii.PATTERNS) == {r.k for r in rows.select(pii._kind(F.element_at(F.regexp_extract_all("text", F.lit(pii.ANY), F.lit(0)), 1)).alias("k")).collect()}


def replaced(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r for r in sorted(pii.surrogates(docs, "k").collect(), key=lambda r: r.doc_id)]


def test_runs_of_digits_are_searched(spark):
    cases = [
        ("card 4111 1111 1111 1111 12/25", "4111 1111", {"card": 1}), ("card 4111-1111-1111-1111 123.", "4111-1111", {"card": 1}), ("4111111111111111 12", "41111111", {"card": 1}),
        ("555-123-4567 555-987-6543", "555-", {"phone": 2}), ("555-123-4567 2024-01-05", "555-123", {"phone": 1}), ("555-123-4567 4111 1111 1111 1111", "1111", {"card": 1, "phone": 1}),
        ("4111 1111 1111 1111 5500 0000 0000 0004", "0000", {"card": 2}), ("555-123-4567 123-45-6789", "123-45", {"phone": 1, "ssn": 1}), ("4111 1111 1111 1111 3rd", "1111", {"card": 1}),
        ("1234567890128 8.8.8.8 x", "8.8.8", {"card": 1, "ip": 1}), ("555-123-4567 1234@x.org", "x.org", {"phone": 1, "email": 1}),
    ]
    for r, (text, gone, kinds) in zip(replaced(spark, [c[0] for c in cases]), cases, strict=True):
        assert gone not in r.text and r.kinds == kinds and re.sub("[0-9]", "", r.text)[:4] == re.sub("[0-9]", "", text)[:4], (text, r.text, r.kinds)
    plain = ["no. 1234 5678 1234 5678 9", "1 234 567 890 123 456 789 012", " ".join(["12"] * 3000)]
    assert [r.text for r in replaced(spark, plain)] == plain


def test_secrets_of_any_length(spark):
    long = "aB3/" * 5000
    cases = [
        (f"token={long} end", long[-12:]), ("password: hunter2.", "hunter2"), ("password=Pa$$w0rd123 x", "0rd123"), ('{"password": "a b, c9"}', "c9"), ("secret=x7", "x7"), ("passwort: ÄÖü12", "ÄÖü"),
        ("api_key='k1'", "k1"), ("token=abc&user=Bob", "abc"), ("password: 4111 1111 1111 1111", "1111"), ("secret: bcdefghi,jkl9", "jkl"),
    ]
    for r, (text, gone) in zip(replaced(spark, [c[0] for c in cases]), cases, strict=True):
        assert gone not in r.text and r.n_entities == 1 and len(r.text) == len(text), (text[:60], r.text[:60])
    plain = ["The secret: the end", "if token == other", "secret: ", "token: [1]"[:6], "password ="]
    assert [r.text for r in replaced(spark, plain)][2:] == plain[2:] and replaced(spark, plain)[0].text == plain[0]


def test_narrow_formats_grow(spark):
    import string

    entities = [("email", f"{c}@corp.com") for c in string.ascii_lowercase] + [("email", f"{k}@corp.com") for k in range(10)] + [("secret", str(k)) for k in range(10)] + [("iban", f"DE{k}") for k in range(7)]
    got = pii.assign(spark.createDataFrame(entities, "kind string, canon string"), "k").collect()
    assert len(got) == len(entities) == len({(r.kind, r.made) for r in got})
    assert not {(r.kind, r.made) for r in got} & set(entities) and len({r.made.partition("@")[2] for r in got if r.kind == "email"}) == 1
    phones = [f"555-123-{k:04d}" for k in range(3)]
    wide = spark.createDataFrame([("phone", p, "9" * 12) for p in phones], "kind string, raw string, made string")
    assert {r.x for r in wide.select(pii._formatted(F.col("kind"), F.col("raw"), F.col("made")).alias("x")).collect()} == {"999-999-999999"}


def test_names_of_any_length(spark):
    texts = ["Dr. Mary Ann Smith, Frau Smith", "so John Michael Smith went", "John Q. Smith.", "by MARY SMITH, MR. SMITH", "Prof. Dr. Hans Peter Karl Müller", "Anna Maria Garcia Lopez"]
    got = replaced(spark, texts)
    for r in got:
        assert not re.search(r"Mary|Ann |Smith|John|Michael|Q\.|MARY|SMITH|Hans|Peter|Karl|Müller|Anna|Maria|Garcia|Lopez", r.text), r.text
    m = re.fullmatch(r"Dr\. \w+ \w+ (\w+), Frau (\w+)", got[0].text)
    assert m and m[1] == m[2] and re.fullmatch(rf"so \w+ \w+ {m[1]} went", got[1].text) and re.fullmatch(rf"\w+ [A-Z][a-z]+ {m[1]}\.", got[2].text)
    assert re.fullmatch(rf"by [A-Z]+ {m[1].upper()}, MR\. {m[1].upper()}", got[3].text) and re.fullmatch(r"Prof\. Dr\. \w+ \w+ \w+ \w+", got[4].text)
    assert [r.text for r in replaced(spark, ["MARY", "John Q.", "Dr. No one"[:3]])] == ["MARY", "John Q.", "Dr."]


def test_addresses_of_any_length(spark):
    labels = "a." * 30_000
    texts = [f"to x@{labels}com, y@{labels}com.", "n" * 5000 + "@q.org", "u@a.com.5 v", "w@" + "b." * 40 + "7", " ".join(f"m{k}@x{k % 7}.org" for k in range(5000))]
    got = replaced(spark, texts)
    assert [r.n_entities for r in got] == [2, 1, 1, 0, 5000] and got[3].text == texts[3] and got[2].text.endswith(".example.5 v")
    assert "com" not in got[0].text and got[0].text.count("@") == 2 and "q.org" not in got[1].text
    hosts = re.findall(r"@(\S+)", got[4].text)
    assert len(set(hosts)) == 7 and [hosts.index(h) for h in hosts] == [k % 7 for k in range(5000)]
    assert len(set(got[4].text.split())) == 5000


def test_short_domains_stay_apart(spark):
    import string

    texts = [f"me@{c}.org" for c in string.ascii_lowercase] + [f"me@{c}.com" for c in string.ascii_lowercase]
    found = [r.text for r in replaced(spark, texts)]
    assert len({t.partition("@")[2] for t in found}) == len(texts) and len({t.partition("@")[0] for t in found}) > 1


def test_against_another_regex_engine(spark):
    """What lies between the matches of the patterns stays, each match is replaced, and like matches are replaced alike."""
    import regex

    any_ = regex.compile("|".join(f"(?:{p})" for p in pii.PATTERNS.values()).replace("\\z", "\\Z").replace(r"\p{IsCyrillic}", r"\p{Cyrillic}"))
    texts = [r[1] for r in ROWS if r[1]] + [f"a{k}@b.org; {k}.{k}.{k}.{k} Frau Meier{k} token=k{k}k9 +1 415 555 01{k:02d}" for k in range(12)]
    for r, t in zip(replaced(spark, texts), texts, strict=True):
        spans = [m.span() for m in any_.finditer(t) if luhn(m[0]) or not re.fullmatch(r"[0-9][0-9 -]{12,}", m[0])]
        between = [t[a:b] for a, b in zip([0, *(e for _, e in spans)], [*(s for s, _ in spans), len(t)], strict=True)]
        assert re.fullmatch("(.+?)".join(map(re.escape, between)), r.text, re.S), (t[:200], r.text[:200])
        assert not [t[a:b] for a, b in spans if t[a:b] in r.text]
