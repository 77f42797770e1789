"""Format-preserving pseudonyms for personal data, with built-in functions only.

Validated values are permuted under a key inside their own format by a Feistel network: equal values get equal
pseudonyms in all documents, different values of one format different ones. The round function is SHA-256 over
key, kind, round and the other half.

kind    validated by                          permuted
card    13 to 19 digits and the Luhn sum      all but the first digit; the last digit is made anew
iban    length and the sum modulo 97          all after the check digits, which are made anew
ssn     area, group and serial ranges         within the valid areas, groups and serials
ip      four numbers up to 255                all four numbers
date    a day from 1900 to 2099               within these days, in the same notation
phone   + and country code, or (area) number  all after the country code; leading digits of a group stay valid
email   shape                                 letters and digits before the @
secret  known key shapes, key = hex value     letters and digits of the value

Digits stay digits, letters stay letters of their case, all other signs stay. A text is searched only if it has
a digit, an @ or the name of a secret before = or :; one pass finds the values, one cuts the text between them.

Defined cases: null stays null; a text without values stays as it is; values that fail their check stay;
repeated rows are changed alike; extra columns stay. Slashed dates are read month first if that is a day, else
day first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: Used only where neither the caller nor the Spark setting KEY_SETTING gives a key; anybody can undo its pseudonyms.
KEY = "quillgraph"
KEY_SETTING = "spark.quillgraph.pii.key"

#: Countries by the length of their IBANs.
_LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}
_OWN = "|".join(f"(?:{c.replace(' ', '|')})\\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + f"(?: ?[A-Z0-9]{{{n % 4}}})" * (n % 4 > 0) + r"\b" for n, c in _LENGTHS.items())
# other countries, and lengths that have changed, by the general form
_IBAN = rf"\b(?=[A-Z]{{2}}\d{{2}})(?:{_OWN}|[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?\b)"

#: In this order; the first that fits at a place wins.
SHAPES = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"\bAKIA[A-Z0-9]{16}\b|(?i:\b(?:password|passwd|token|secret|api_?key)\b)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9]{12,}",
    "iban": _IBAN,
    "date": r"(?<![\d./\-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/\-]|\.\d)",
    "ip": r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\d|\.\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,3}(?!\d)|\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)|(?<![\d.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\d\-])",
    "card": r"(?<!\d)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)",
}
#: Texts without it hold no value.
HINT = r"[0-9@]|(?i:password|passwd|token|secret|api_?key)\s{0,3}[=:]"
ANY = "|".join(f"(?:{shape})" for shape in SHAPES.values())


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _is(kind: str) -> str:
    # the match stands alone here, so what looks around it holds at its ends
    return f"regexp_like(m, {_text('^(?:' + SHAPES[kind] + ')$')})"


def _noise(kind: str, key: str, *parts: str) -> str:
    """A number of 48 bits from the key and the parts."""
    joined = ", '|', ".join(f"CAST({p} AS string)" for p in parts)
    return f"CAST(conv(substr(sha2(concat({_text(f'{key}|{kind}|')}, {joined}), 256), 1, 12), 16, 10) AS bigint)"


def _signs(kind: str, key: str, value: str, first: str, end: str, hexadecimal: str = "false") -> str:
    """``value`` with its letters and digits from ``first`` up to ``end`` permuted sign by sign in two halves."""
    cell = "named_struct('v', CAST({v} AS int), 'm', CAST({m} AS int), 'b', CAST({b} AS int))"
    digit = cell.format(v="ascii(c) - 48", m="10", b="48")
    if kind == "phone":  # the first digit of a group: 2 to 9 among themselves, 0 and 1 too
        opens = f"NOT regexp_like(substr({value}, i, 1), '[0-9]')"
        digit = f"CASE WHEN {opens} AND c >= '2' THEN {cell.format(v='ascii(c) - 50', m='8', b='50')} WHEN {opens} THEN {cell.format(v='ascii(c) - 48', m='2', b='48')} ELSE {digit} END"
    cells = f"""transform(split({value}, ''), (c, i) -> CASE
        WHEN i < {first} OR i >= {end} THEN {cell.format(v='0', m='1', b='ascii(c)')}
        WHEN c BETWEEN '0' AND '9' THEN {digit}
        WHEN c BETWEEN 'a' AND 'z' THEN {cell.format(v='ascii(c) - 97', m=f'IF({hexadecimal}, 6, 26)', b='97')}
        WHEN c BETWEEN 'A' AND 'Z' THEN {cell.format(v='ascii(c) - 65', m='26', b='65')}
        ELSE {cell.format(v='0', m='1', b='ascii(c)')} END)"""
    cut = f"({first} + {end}) div 2"
    other = f"array_join(transform(filter(acc, (y, j) -> (j < {cut}) = (r % 2 = 1)), y -> CAST(y.v AS string)), ',')"
    moved = cell.format(v=f"pmod(x.v + {_noise(kind, key, 'r', 'i', 'size(acc)', other)}, x.m)", m="x.m", b="x.b")
    turned = f"transform(acc, (x, i) -> IF(x.m > 1 AND (i < {cut}) = (r % 2 = 0), {moved}, x))"
    return f"array_join(transform(aggregate(sequence(0, {ROUNDS - 1}), {cells}, (acc, r) -> {turned}), x -> char(x.b + x.v)), '')"


def _pair(kind: str, key: str, left: str, right: str, a: int, b: int) -> str:
    """struct(l, r): the pair permuted within a times b values."""
    start = f"named_struct('l', CAST({left} AS bigint), 'r', CAST({right} AS bigint))"
    even = f"named_struct('l', pmod(acc.l + {_noise(kind, key, 'k', 'acc.r')}, {a}L), 'r', acc.r)"
    odd = f"named_struct('l', acc.l, 'r', pmod(acc.r + {_noise(kind, key, 'k', 'acc.l')}, {b}L))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (acc, k) -> IF(k % 2 = 0, {even}, {odd}))"


def _with(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """Luhn sum of a run of digits, the last being the check digit."""
    doubled = "CAST((CAST(d AS int) * 2) div 10 + (CAST(d AS int) * 2) % 10 AS int)"
    return f"aggregate(transform(split(reverse({digits}), ''), (d, i) -> IF(i % 2 = 1, {doubled}, CAST(d AS int))), 0, (t, x) -> t + x)"


def _mod97(value: str) -> str:
    """The ISO 13616 remainder of letters and digits: letters count from 10."""
    step = "IF(c BETWEEN '0' AND '9', (t * 10 + ascii(c) - 48) % 97, (t * 100 + ascii(c) - 55) % 97)"
    return f"aggregate(split({value}, ''), 0, (t, c) -> CAST({step} AS int))"


def _card(key: str) -> str:
    shuffled = _signs("card", key, "m", "1", "length(m) - 1")
    fresh = f"concat(substr(w, 1, length(w) - 1), CAST(pmod(-{_luhn(_digits('concat(substr(w, 1, length(w) - 1), 0)'))}, 10) AS string))"
    return f"IF({_luhn(_digits('m'))} % 10 = 0 AND {_digits('m')} > '0' AND NOT regexp_like({_digits('m')}, '^0+$'), {_with(shuffled, 'w', fresh)}, m)"


def _iban(key: str) -> str:
    # what follows in capitals or digits may be in the match: the longest valid start counts
    bare = "replace(substr(m, 1, e), ' ', '')"
    valid = f"length({bare}) BETWEEN 15 AND 34 AND {_mod97(f'concat(substr({bare}, 5), substr({bare}, 1, 4))')} = 1"
    shuffled = _signs("iban", key, "m", "4", "length(m)")
    inner = "replace(w, ' ', '')"
    check = f"lpad(CAST(98 - {_mod97(f'''concat(substr({inner}, 5), substr({inner}, 1, 2), '00')''')} AS string), 2, '0')"
    fresh = f"concat(substr(w, 1, 2), {check}, substr(w, 5))"
    ends = f"filter(transform(sequence(0, length(m) - 1), d -> length(m) - d), e -> (e = length(m) OR substr(m, e + 1, 1) = ' ') AND {valid})"
    one = _with("substr(m, 1, e)", "m", _with(shuffled, "w", fresh))
    return f"coalesce(get(transform(slice({ends}, 1, 1), e -> concat({one}, substr(m, e + 1))), 0), m)"


def _ssn(key: str) -> str:
    area, group, serial = "CAST(substr(m, 1, 3) AS int)", "CAST(substr(m, 5, 2) AS int)", "CAST(substr(m, 8, 4) AS int)"
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    # areas 1 to 899 without 666 count from 0 to 897
    place = _pair("ssn", key, f"{area} - IF({area} > 666, 2, 1)", f"({group} - 1) * 9999 + {serial} - 1", 898, 99 * 9999)
    fresh = "format_string('%03d-%02d-%04d', w.l + IF(w.l >= 665, 2, 1), w.r div 9999 + 1, w.r % 9999 + 1)"
    return f"IF({valid}, {_with(place, 'w', fresh)}, m)"


def _ip(key: str) -> str:
    part = [f"CAST(split_part(m, '.', {k}) AS int)" for k in range(1, 5)]
    valid = f"regexp_like(m, '^(?:0|[1-9][0-9]*)(?:[.](?:0|[1-9][0-9]*)){{3}}$') AND greatest({', '.join(part)}) <= 255"
    place = _pair("ip", key, f"{part[0]} * 256 + {part[1]}", f"{part[2]} * 256 + {part[3]}", 65536, 65536)
    fresh = "concat_ws('.', w.l div 256, w.l % 256, w.r div 256, w.r % 256)"
    return f"IF({valid}, {_with(place, 'w', fresh)}, m)"


#: The days from 1900-01-01 to 2099-12-31, and a rectangle of pairs that holds them.
DAYS, DAY_ROWS, DAY_COLUMNS = 73049, 271, 270


def _date(key: str) -> str:
    def moved(day: str) -> str:
        # pairs beyond the last day are walked through until a day comes
        once = _with(_pair("date", key, f"z div {DAY_COLUMNS}", f"z % {DAY_COLUMNS}", DAY_ROWS, DAY_COLUMNS), "p", f"CAST(p.l * {DAY_COLUMNS} + p.r AS bigint)")
        return f"aggregate(sequence(1, 8), CAST(-1 AS bigint), (y, q) -> IF(y BETWEEN 0 AND {DAYS - 1}, y, {_with(f'IF(q = 1, {day}, y)', 'z', once)}))"

    def made(date: str, shape: str) -> str:
        number = f"CAST(datediff({date}, DATE'1900-01-01') AS bigint)"
        return f"IF({number} BETWEEN 0 AND {DAYS - 1}, date_format(date_add(DATE'1900-01-01', CAST({moved(number)} AS int)), {shape}), m)"

    def read(y: str, mo: str, d: str) -> str:
        return f"try_cast(concat({y}, '-', lpad({mo}, 2, '0'), '-', lpad({d}, 2, '0')) AS date)"

    def by(sign: str, k: int) -> str:
        return f"split_part(m, '{sign}', {k})"

    def shape(order: str, sign: str) -> str:
        wide, narrow = {"md": f"MM{sign}dd{sign}yyyy", "dm": f"dd{sign}MM{sign}yyyy"}[order], {"md": f"M{sign}d{sign}yyyy", "dm": f"d{sign}M{sign}yyyy"}[order]
        return f"IF(length(m) = 10, '{wide}', '{narrow}')"

    iso, us, eu, dotted = read("substr(m, 1, 4)", "substr(m, 6, 2)", "substr(m, 9, 2)"), read(by("/", 3), by("/", 1), by("/", 2)), read(by("/", 3), by("/", 2), by("/", 1)), read(by(".", 3), by(".", 2), by(".", 1))
    return f"""CASE WHEN substr(m, 5, 1) = '-' THEN IF({iso} IS NULL, m, {made(iso, "'yyyy-MM-dd'")})
        WHEN contains(m, '/') THEN CASE WHEN {us} IS NOT NULL THEN {made(us, shape('md', '/'))} WHEN {eu} IS NOT NULL THEN {made(eu, shape('dm', '/'))} ELSE m END
        WHEN {dotted} IS NOT NULL THEN {made(dotted, shape('dm', '.'))} ELSE m END"""


def _phone(key: str) -> str:
    code = "IF(startswith(m, '+'), IF(regexp_like(m, '^[+][0-9]{1,3}[^0-9]'), length(regexp_extract(m, '^[+][0-9]{1,3}', 0)), 2), 0)"
    return _signs("phone", key, "m", code, "length(m)")


def _secret(key: str) -> str:
    start = "IF(startswith(m, 'AKIA'), 4, length(m) - length(regexp_extract(m, '[A-Za-z0-9]{12,}$', 0)))"
    return _signs("secret", key, "m", start, "length(m)", "regexp_like(m, '[^A-Za-z0-9][0-9a-f]{12,}$')")


def _kind() -> str:
    return "CASE " + " ".join(f"WHEN {_is(k)} THEN '{k}'" for k in SHAPES) + " END"


def _pseudonym(key: str) -> str:
    made = {"email": _signs("email", key, "m", "0", "locate('@', m) - 1"), "secret": _secret(key), "iban": _iban(key), "date": _date(key), "ip": _ip(key), "ssn": _ssn(key), "phone": _phone(key), "card": _card(key)}
    return "CASE " + " ".join(f"WHEN k = '{kind}' THEN {sql}" for kind, sql in made.items()) + " ELSE m END"


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", found: str | None = None) -> DataFrame:
    """``docs``, all columns, with pseudonyms in ``text``; ``found`` names an added array of (kind, changed) if wanted."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, KEY)
    own = [F.col(f"`{c}`") for c in docs.columns if c != text]
    held = docs.select(F.struct(*own, F.lit(1).alias("__one")).alias("own"), F.col(f"`{text}`").cast("string").alias("t"))
    searched = F.when(F.col("t").rlike(HINT), F.regexp_extract_all("t", F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    held = held.withColumn("ms", searched)
    named = _with(_kind(), "k", f"named_struct('m', m, 'k', k, 'p', {_pseudonym(key)})")
    held = held.withColumn("ps", F.expr(f"transform(ms, m -> {named})"))
    between = F.split("t", ANY, -1)
    joined = F.array_join(F.zip_with(between, F.col("ps"), lambda b, p: F.concat(b, F.coalesce(p["p"], F.lit("")))), "")
    changed: Column = F.when(F.size("ms") > 0, joined).otherwise(F.col("t"))
    columns = [changed.alias(text) if c == text else F.col(f"own.`{c}`").alias(c) for c in docs.columns]
    if found:
        columns.append(F.expr("transform(ps, x -> struct(x.k AS kind, x.m <> x.p AS changed))").alias(found))
    return held.select(*columns)
