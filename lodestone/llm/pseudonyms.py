"""PII: format-preserving Feistel pseudonyms.

Numbers and dates that pass their validation are replaced by others of the same format and validity. A value is two
residues (l mod a, r mod b); each round adds a keyed hash of one to the other, so the rounds permute the a * b values of
the format, whatever a and b are. Equal values under one key have equal pseudonyms in every document, however they
are punctuated, and different values keep different ones. All is a single pass of SQL functions over the texts. The
key is read from a table of one row, so it is in no plan, event log or page of the UI.

  card   13 to 19 digits, plain or in the usual groups, with a right Luhn digit: the first digit stays, the Luhn digit
         is made anew
  phone  North American numbers, +1 or not: area, exchange and line stay valid; the country code stays
  intl   + and 8 to 15 digits: the first three digits stay
  ssn    ddd-dd-dddd with an area, group and serial that can be assigned
  date   year-month-day, day.month.year, day-month-year or month/day/year that is in the calendar, 1800 to 2199: the
         days of 400 years are 189 * 773. Dates with slashes that only make sense with the day first stay: month/day
         results could not be told from theirs
  ipv4   four numbers to 255
  email  letters and digits before the @, each within its class; the domain stays

A null text stays null and has no findings; an empty one has none. Each row is rewritten by itself: repeated rows get
equal results, an empty table gives an empty one, long texts are rewritten whole, and other columns are kept, whatever
their names; only one that has the name of the findings gives way to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tasks import boxed, unboxed

ROUNDS = 8

#: name: pattern. Earlier ones win where two could start at one place. Loops over groups are possessive or bounded: Java
#: matches any other by a call for each turn, and a long text would end the JVM by its stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9][A-Za-z0-9._%+\-]*+@[A-Za-z0-9\-]++(?:\.(?:-*+[A-Za-z0-9]++)++)++",
    "phone": r"(?<![\w+(])(?:\+?1[ .\-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .\-])[2-9][0-9]{2}[ .\-][0-9]{4}(?!\w)",
    "intl": r"(?<![\w+])\+[1-9][0-9]{0,2}(?:[ .\-]?\(?[0-9]{1,5}\)?){2,5}(?!\w)",
    "card": r"(?<![\w])(?:[0-9]{13,19}|[0-9]{4}(?:[ \-][0-9]{4}){3}|[0-9]{4}[ \-][0-9]{6}[ \-][0-9]{5})(?!\w)",
    "ssn": r"(?<![\w\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w\-])",
    "date": r"(?<![\w.\-/])(?:[0-9]{4}([\-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([.\-/])[0-9]{2}\2[0-9]{4})(?![\w\-/]|\.[0-9])",
    "ipv4": r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\w|\.[0-9])",
}
#: The date pattern has two groups that it refers to; they are the only ones.
ANY = "|".join(PATTERNS.values())


def _permuted(l: str, a: str, r: str, b: str, key: str, kind: str) -> str:
    """SQL of a struct (l, r): the rounds over residues l mod a and r mod b."""
    added = lambda value, of: f"cast(conv(substring(sha2(concat_ws('|', {key}, '{kind}', k, {value}), 256), 1, 13), 16, 10) as bigint) % {of}"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({l} as bigint), 'r', cast({r} as bigint)), (s, k) -> if(k % 2 = 1, "
        f"named_struct('l', (s.l + {added('s.r', a)}) % {a}, 'r', s.r), named_struct('l', s.l, 'r', (s.r + {added('s.l', b)}) % {b})))"
    )


def _let(name: str, value: str, then: str) -> str:
    """SQL that names a value."""
    return f"get(transform(array({value}), {name} -> {then}), 0)"


def _fill(value: str, digits: str) -> str:
    """SQL: the value with its digits replaced by others, in order."""
    return (
        f"aggregate(split({value}, ''), named_struct('out', '', 'at', 1), (s, x) -> if(x rlike '[0-9]', "
        f"named_struct('out', concat(s.out, substring({digits}, s.at, 1)), 'at', s.at + 1), named_struct('out', concat(s.out, x), 'at', s.at)), s -> s.out)"
    )


def _number(digits: str, keep: int, last: int, key: str, kind: str) -> str:
    """SQL: digits with all but the first `keep` and the last `last` permuted, those last left out."""
    n = f"(length({digits}) - {keep + last})"
    left = f"({n} div 2)"
    power = lambda e: f"cast(pow(10, {e}) as bigint)"
    halves = _permuted(f"substring({digits}, {keep + 1}, {left})", power(left), f"substring({digits}, {keep + 1} + {left}, {n} - {left})", power(f"({n} - {left})"), key, kind)
    return _let("h", halves, f"concat(left({digits}, {keep}), lpad(h.l, {left}, '0'), lpad(h.r, {n} - {left}, '0'))")


def _kinds(key: str) -> list[tuple[str, str, str]]:
    """name, SQL of the validation of v, SQL of its pseudonym; d is the digits of v."""
    day = "coalesce(try_to_date(v, 'yyyy-MM-dd'), try_to_date(v, 'yyyy/MM/dd'), try_to_date(v, 'yyyy.MM.dd'), try_to_date(v, 'dd.MM.yyyy'), try_to_date(v, 'dd-MM-yyyy'), try_to_date(v, 'MM/dd/yyyy'))"
    shape = "case when v rlike '^[0-9]{4}-' then 'yyyy-MM-dd' when v rlike '^[0-9]{4}/' then 'yyyy/MM/dd' when v rlike '^[0-9]{4}[.]' then 'yyyy.MM.dd' when v rlike '[.]' then 'dd.MM.yyyy' when v rlike '-' then 'dd-MM-yyyy' else 'MM/dd/yyyy' end"
    number = f"datediff({day}, date'1800-01-01')"
    days = _permuted(f"{number} div 773", "189", f"{number} % 773", "773", key, "date")
    card = _let("p", _number("d", 1, 1, key, "card"), f"{_fill('v', 'concat(p, get(filter(split(' + chr(39) + '0123456789' + chr(39) + ', ' + chr(39) + chr(39) + '), c -> luhn_check(concat(p, c))), 0))')}")
    phone_digits = "right(d, 10)"
    phone = _let(
        "h",
        _permuted(f"cast(substring({phone_digits}, 1, 3) as int) - 200", "800", f"cast(substring({phone_digits}, 4, 7) as int) - 2000000", "8000000", key, "phone"),
        _fill("v", "concat(left(d, length(d) - 10), h.l + 200, h.r + 2000000)"),
    )
    area = "cast(left(d, 3) as int)"
    ssn = _let(
        "h",
        _permuted(f"{area} - 1 - if({area} > 666, 1, 0)", "898", f"(cast(substring(d, 4, 2) as int) - 1) * 9999 + cast(right(d, 4) as int) - 1", "989901", key, "ssn"),
        "concat(lpad(h.l + 1 + if(h.l >= 665, 1, 0), 3, '0'), '-', lpad(h.r div 9999 + 1, 2, '0'), '-', lpad(h.r % 9999 + 1, 4, '0'))",
    )
    octet = lambda i: f"cast(get(split(v, '[.]'), {i}) as int)"
    ipv4 = _let("h", _permuted(f"{octet(0)} * 256 + {octet(1)}", "65536", f"{octet(2)} * 256 + {octet(3)}", "65536", key, "ipv4"), "concat_ws('.', h.l div 256, h.l % 256, h.r div 256, h.r % 256)")
    return [
        ("email", "v rlike '@'", _email(key)),
        ("card", "v not rlike '[+(.]' and length(d) between 13 and 19 and luhn_check(d)", card),
        ("phone", r"v rlike '^(?:\\+?1[ .\\-]?)?(?:\\([2-9][0-9]{2}\\) ?|[2-9][0-9]{2}[ .\\-])[2-9][0-9]{2}[ .\\-][0-9]{4}$'", phone),
        ("intl", "v like '+%' and length(d) between 8 and 15", _let("p", _number("d", 3, 0, key, "intl"), _fill("v", "p"))),
        ("ssn", "v rlike '^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$'", ssn),
        ("ipv4", "v rlike '^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:[.]|$)){4}$'", ipv4),
        ("date", f"v rlike '^(?:[0-9]{{4}}[-/.][0-9]{{2}}[-/.]|[0-9]{{2}}[-./][0-9]{{2}}[-./])' and {day} between date'1800-01-01' and date'2199-12-31'", _let("h", days, f"date_format(date_add(date'1800-01-01', cast(h.l * 773 + h.r as int)), {shape})")),
    ]


def _email(key: str) -> str:
    """Halves of the local part by turns: each letter or digit moves within its class by a keyed hash of the other."""
    moved = lambda half, other: _let(
        "o",
        f"sha2({other}, 256)",
        f"array_join(transform(split({half}, ''), (x, i) -> "
        + _let(
            "z",
            f"cast(conv(substring(sha2(concat_ws('|', {key}, 'email', k, i, o), 256), 1, 8), 16, 10) as bigint)",
            "case when x rlike '[0-9]' then cast((ascii(x) - 48 + z) % 10 as string) when x rlike '[a-z]' then chr((ascii(x) - 97 + z) % 26 + 97) when x rlike '[A-Z]' then chr((ascii(x) - 65 + z) % 26 + 65) else x end",
        )
        + "), '')",
    )
    local = "substring_index(v, '@', 1)"
    start = f"named_struct('l', left({local}, length({local}) div 2), 'r', substring({local}, length({local}) div 2 + 1))"
    rounds = f"aggregate(sequence(1, {ROUNDS}), {start}, (s, k) -> if(k % 2 = 1, named_struct('l', if(s.l = '', '', {moved('s.l', 's.r')}), 'r', s.r), named_struct('l', s.l, 'r', {moved('s.r', 's.l')})), s -> concat(s.l, s.r))"
    return f"concat({rounds}, substring(v, instr(v, '@')))"


def pseudonymised(docs: DataFrame, key: str, text: str = "text", findings: str = "findings") -> DataFrame:
    """docs with the text rewritten and the column `findings`, an array of structs (kind, start from 1, length in the
    given text, pseudonym)."""
    held = docs.sparkSession.createDataFrame([(key,)], "key string")
    given = F.coalesce("text", F.lit(""))
    rows = boxed(docs, text=text).withColumns({"key": held.scalar(), "values": F.regexp_extract_all(given, F.lit(ANY), F.lit(0)), "parts": F.split(given, ANY, -1)})
    kinds = _kinds("key")
    kind = "case " + " ".join(f"when {valid} then '{name}'" for name, valid, _ in kinds) + " end"
    other = "case t " + " ".join(f"when '{name}' then {made}" for name, _, made in kinds) + " end"
    each = _let("d", "regexp_replace(v, '[^0-9]', '')", _let("t", kind, f"named_struct('kind', t, 'pseudonym', {other})"))
    rows = rows.withColumn("made", F.expr(f"transform(values, v -> {each})"))
    at = "if(size(values) = 0, cast(array() as array<int>), sequence(0, size(values) - 1))"
    starts = f"""aggregate({at}, named_struct('next', 1, 'starts', cast(array() as array<int>)),
        (s, i) -> named_struct('next', s.next + length(get(parts, i)) + length(get(values, i)), 'starts', concat(s.starts, array(s.next + length(get(parts, i))))), s -> s.starts)"""
    rows = rows.withColumn("starts", F.expr(starts))
    found = "transform(filter(arrays_zip(made, starts, values), f -> f.made.kind is not null), f -> named_struct('kind', f.made.kind, 'start', f.starts, 'length', length(f.values), 'pseudonym', f.made.pseudonym))"
    rebuilt = "array_join(transform(arrays_zip(parts, values, made), f -> concat(f.parts, coalesce(f.made.pseudonym, f.values, ''))), '')"
    kept = [c for c in docs.columns if c.lower() != findings.lower()]
    return rows.select(*unboxed(kept, **{text: F.expr(f"if(size(values) = 0, text, {rebuilt})")}), F.expr(found).alias(findings))
