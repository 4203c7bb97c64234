"""PII: format-preserving Feistel pseudonyms.

Card numbers, telephone numbers, social-security numbers, IPv4 addresses, dates, e-mail names and access
keys are found by one expression, validated (check digit, ranges of the calendar, of octets and of number
plans), and permuted by a
keyed Feistel network within their format: digits stay digits in their places, a card number keeps a
valid check digit, a social-security or North American telephone number stays one that can be given out, a
date stays a date of the same notation.  Equal values get equal pseudonyms in every document, and nobody
without the key can tell which value they stand for.  The key comes from the session's configuration as a
scalar subquery, so no plan, page or event log shows it.

A text is cut at its findings; the findings are replaced and the parts joined again, all by expressions
over one row.  Cases: null stays null; an empty text stays empty; what fails validation stays as it is;
repeated rows get equal texts; an empty table gives no rows; other columns, whatever their names, pass
through, except one named as the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachbase.llm.words import unused

ROUNDS = 6
#: What no finding may follow, so that the search starts at the borders of words only.
_START, _END = r"(?<![\w.%+\-])", r"(?![\w\-]|\.\d)"
_CARD = rf"\d(?:[ \-]?\d){{12,18}}{_END}"
_PHONE = rf"(?:\+\d{{1,3}}[ .\-]?)?(?:\(\d{{3}}\)[ ]?|\d{{3}}[ .\-])\d{{3}}[ .\-]\d{{4}}{_END}|\+\d{{1,3}}(?:[ .\-]?\d{{2,4}}){{2,5}}{_END}"
_SSN = rf"\d{{3}}-\d{{2}}-\d{{4}}{_END}"
_IP = rf"\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}\.\d{{1,3}}{_END}"
_DATE = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|\d{{2}}/\d{{2}}/\d{{4}}|\d{{2}}\.\d{{2}}\.\d{{4}}){_END}"
_MAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9](?:[A-Za-z0-9.\-]*[A-Za-z0-9])?\.[A-Za-z]{2,}"
_KEY = r"AKIA[0-9A-Z]{16}(?!\w)"
_SECRET = r"(?=[a-f]*[0-9])[0-9a-f]{18,64}(?!\w)"
KINDS = {"mail": _MAIL, "date": _DATE, "ip": _IP, "ssn": _SSN, "phone": _PHONE, "card": _CARD, "key": _KEY, "secret": _SECRET}
ANY = _START + "(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
_ALPHABETS = {"secret": ["0123456789abcdef"]}
_PLAIN_ALPHABETS = ["0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"]
#: Days of one whole cycle of the Gregorian calendar, from 1800-01-01 on: 189 * 773.
_FIRST_DAY, _DAY_ROWS, _DAY_COLUMNS = "1800-01-01", 189, 773


def _draw(key: str, tag: str, half: str, modulus: str) -> str:
    """A keyed pseudo-random number below the modulus, as SQL."""
    return f"pmod(cast(conv(substr(sha2(concat_ws(':', {key}, '{tag}', cast({half} as string)), 256), 1, 15), 16, 10) as bigint), {modulus})"


def _network(left: str, right: str, left_size: str, right_size: str, key: str, tag: str) -> str:
    """SQL of an array(left, right): rounds add a keyed draw of one half to the other, modulo its size."""
    state = f"struct(cast({left} as bigint) as a, cast({right} as bigint) as b)"
    step = (
        f"CASE WHEN r % 2 = 0 THEN struct(pmod(s.a + {_draw(key, tag + 'a', 'concat(r, s.b)', left_size)}, {left_size}) as a, s.b as b)"
        f" ELSE struct(s.a as a, pmod(s.b + {_draw(key, tag + 'b', 'concat(r, s.a)', right_size)}, {right_size}) as b) END"
    )
    return f"aggregate(sequence(0, {ROUNDS - 1}), {state}, (s, r) -> {step})"


def _power(n: str) -> str:
    return f"cast(pow(10, {n}) as bigint)"


def _digits(value: str, key: str, tag: str) -> str:
    """SQL: a string of 2 to 36 digits permuted among the strings of its length."""
    half, rest = f"(length({value}) div 2)", f"(length({value}) - length({value}) div 2)"
    net = _network(f"substr({value}, 1, {half})", f"substr({value}, {half} + 1)", _power(half), _power(rest), key, f"{tag}")
    return f"transform(array({net}), n -> concat(lpad(n.a, {half}, '0'), lpad(n.b, {rest}, '0')))[0]"


def _only(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: the Luhn sum of digits that a check digit still follows."""
    return f"aggregate(transform(split({digits}, ''), (d, i) -> CASE WHEN (length({digits}) - i) % 2 = 1 THEN (2 * cast(d as int)) div 10 + (2 * cast(d as int)) % 10 ELSE cast(d as bigint) END), 0L, (a, d) -> a + d)"


def _refill(value: str, digits: str) -> str:
    """SQL: the value with its digits replaced in their places."""
    return f"aggregate(split({value}, ''), struct('' as o, 1 as k), (s, c) -> CASE WHEN c RLIKE '^[0-9]$' THEN struct(concat(s.o, substr({digits}, s.k, 1)) as o, s.k + 1 as k) ELSE struct(concat(s.o, c) as o, s.k as k) END, s -> s.o)"


def _letters(value: str, key: str, tag: str) -> str:
    """SQL: each letter and digit of the value moved within its own alphabet by draws keyed on the whole value.

    A value of n characters is its own round input by halves: the right half moves the left one and the
    moved left half moves the right one, twice over, so the map is a permutation for each format.
    """
    alphabets = _ALPHABETS.get(tag, _PLAIN_ALPHABETS)

    def moved(part: str, by: str, r: int) -> str:
        cases = "".join(f" WHEN instr('{a}', c) > 0 THEN substr('{a}', 1 + cast(pmod(instr('{a}', c) - 1 + cast(conv(substr(g, 1 + (3 * i) % 60, 3), 16, 10) as int), {len(a)}) as int), 1)" for a in alphabets)
        return f"transform(array(sha2(concat({key}, ':{tag}{r}:', {by}), 256)), g -> array_join(transform(split({part}, ''), (c, i) -> CASE{cases} ELSE c END), ''))[0]"

    state = f"struct(substr({value}, 1, length({value}) div 2) as a, substr({value}, length({value}) div 2 + 1) as b)"
    step = f"CASE WHEN r % 2 = 0 THEN struct({moved('s.a', 'concat(r, s.b)', 0)} as a, s.b as b) ELSE struct(s.a as a, {moved('s.b', 'concat(r, s.a)', 1)} as b) END"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {state}, (s, r) -> {step}, s -> concat(s.a, s.b))"


def _card(v: str, key: str) -> str:
    body = f"substr({_only(v)}, 1, length({_only(v)}) - 1)"
    new = f"transform(array({_digits(body, key, 'card')}), b -> concat(b, (10 - {_luhn('b')} % 10) % 10))[0]"
    return f"transform(array({new}), d -> {_refill(v, 'd')})[0]"


def _date(v: str, key: str) -> str:
    day = lambda layout: f"try_to_timestamp({v}, '{layout}')"
    out = []
    for shape, layout in (("-", "yyyy-MM-dd"), ("/", "MM/dd/yyyy"), (".", "dd.MM.yyyy")):
        number = f"datediff(cast({day(layout)} as date), date'{_FIRST_DAY}')"
        net = _network(f"{number} div {_DAY_COLUMNS}", f"{number} % {_DAY_COLUMNS}", str(_DAY_ROWS), str(_DAY_COLUMNS), key, "date")
        new = f"transform(array({net}), n -> date_format(date_add(date'{_FIRST_DAY}', cast(n.a * {_DAY_COLUMNS} + n.b as int)), '{layout}'))[0]"
        out.append(f"WHEN instr({v}, '{shape}') > 0 THEN CASE WHEN {number} BETWEEN 0 AND {_DAY_ROWS * _DAY_COLUMNS - 1} THEN {new} ELSE {v} END")
    return f"CASE {' '.join(out)} ELSE {v} END"


def _ssn(v: str, key: str) -> str:
    """Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999, numbered without gaps."""
    d = _only(v)
    area, group, serial = (f"cast(substr({d}, {at}, {n}) as bigint)" for at, n in ((1, 3), (4, 2), (6, 4)))
    net = _network(f"({area} - 1 - cast({area} > 666 as bigint)) * 99 + {group} - 1", f"{serial} - 1", "88902", "9999", key, "ssn")
    fresh = "n.a div 99 + 1 + cast(n.a div 99 + 1 >= 666 as bigint)"
    digits = f"transform(array({net}), n -> concat(lpad({fresh}, 3, '0'), lpad(n.a % 99 + 1, 2, '0'), lpad(n.b + 1, 4, '0')))[0]"
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    return f"CASE WHEN {valid} THEN transform(array({digits}), d -> {_refill(v, 'd')})[0] ELSE {v} END"


def _phone(v: str, key: str) -> str:
    """Ten digits of the North American plan, area and exchange from 200 on, after an optional 1; else 7 to 15 digits after a plus."""
    d = _only(v)
    last = f"right({d}, 10)"
    net = _network(f"cast(substr({last}, 1, 3) as bigint) - 200", f"cast(substr({last}, 4) as bigint) - 2000000", "800", "8000000", key, "phone")
    american = f"transform(array({net}), n -> concat(substr({d}, 1, length({d}) - 10), lpad(n.a + 200, 3, '0'), lpad(n.b + 2000000, 7, '0')))[0]"
    filled = lambda digits: f"transform(array({digits}), d -> {_refill(v, 'd')})[0]"
    return f"CASE WHEN {d} RLIKE '^1?[2-9][0-9]{{2}}[2-9][0-9]{{6}}$' THEN {filled(american)} WHEN {v} LIKE '+%' AND length({d}) BETWEEN 7 AND 15 THEN {filled(_digits(d, key, 'phone'))} ELSE {v} END"


def _ip(v: str, key: str) -> str:
    part = lambda i: f"cast(split({v}, '[.]')[{i}] as bigint)"
    net = _network(f"{part(0)} * 256 + {part(1)}", f"{part(2)} * 256 + {part(3)}", "65536", "65536", key, "ip")
    return f"transform(array({net}), n -> concat_ws('.', n.a div 256, n.a % 256, n.b div 256, n.b % 256))[0]"


def pseudonym(v: str, key: str) -> str:
    """SQL: the pseudonym of one finding; what does not hold up as any kind stays."""
    whole = lambda k: f"{v} RLIKE '^(?:{_plain(KINDS[k])})$'"
    octets = f"forall(split({v}, '[.]'), o -> cast(o as int) <= 255)"
    filled = lambda tag: f"transform(array({_digits(_only(v), key, tag)}), d -> {_refill(v, 'd')})[0]"
    valid_card = f"length({_only(v)}) BETWEEN 13 AND 19 AND ({_luhn(f'substr({_only(v)}, 1, length({_only(v)}) - 1)')} + cast(right({_only(v)}, 1) as int)) % 10 = 0"
    return (
        f"CASE WHEN instr({v}, '@') > 0 THEN concat({_letters(f'''substring_index({v}, '@', 1)''', key, 'mail')}, '@', substring_index({v}, '@', -1))"
        f" WHEN {whole('date')} THEN {_date(v, key)}"
        f" WHEN {whole('ip')} THEN CASE WHEN {octets} THEN {_ip(v, key)} ELSE {v} END"
        f" WHEN {whole('ssn')} THEN {_ssn(v, key)}"
        f" WHEN {whole('phone')} THEN {_phone(v, key)}"
        f" WHEN {v} LIKE 'AKIA%' THEN concat('AKIA', {_letters(f'substr({v}, 5)', key, 'key')})"
        f" WHEN {v} RLIKE '[a-f]' OR length({v}) > 36 THEN {_letters(v, key, 'secret')}"
        f" WHEN {valid_card} THEN {_card(v, key)}"
        f" WHEN length({_only(v)}) BETWEEN 13 AND 36 THEN {filled('number')} ELSE {v} END"
    )


def _plain(pattern: str) -> str:
    return pattern.replace("\\", "\\\\")


#: The session's setting that holds the key; Spark blacks out settings of such names wherever it shows them.
KEY_SETTING = "spark.corpus.pseudonym.secret"
#: For tests and demonstrations; whoever works on real data sets a secret one.
STAND_IN = "corpuskey"


def key_of(session: SparkSession) -> Column:
    """The key of the session's configuration."""
    key = session.conf.get(KEY_SETTING, STAND_IN)
    if not key:
        raise ValueError(f"{KEY_SETTING} is empty")
    return session.createDataFrame([(key,)], "key string").scalar()


def pseudonymise(docs: DataFrame, text: str = "text", to: str | None = None, found: str | None = None) -> DataFrame:
    """``docs`` with the findings of ``text`` replaced, in ``to`` (default: in place); ``found``, if given, counts them."""
    held, key = unused(docs, "_found", "_key")
    rows = docs.withColumns({held: F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))), key: key_of(docs.sparkSession)})
    cut = F.split(F.col(text), ANY, -1)
    new = F.expr(f"transform({held}, v -> {pseudonym('v', key)})")
    joined: Column = F.array_join(F.zip_with(cut, new, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    rows = rows.withColumn(to or text, F.when(F.size(held) > 0, joined).otherwise(F.col(text)))
    if found:
        rows = rows.withColumn(found, F.coalesce(F.size(held), F.lit(0)).cast("long"))
    return rows.drop(held, key)
