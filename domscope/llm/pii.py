"""Format-preserving pseudonyms for personal data, in SQL expressions alone.

Candidates are found by one regular expression and validated by kind: payment cards (Luhn), IBANs in capitals (mod 97),
dates (a day from 1900 to 2099, also at the head of a timestamp), IP addresses, social security numbers, telephone numbers with
separators or a country code, e-mail names. IPv4 octets have no leading zeros; IPv6 addresses have eight groups or ``::``, a digit, and a group of
three characters or more, and keep which characters are digits and which are letters.
What is valid is written as two numbers (l, r) with l < a and r < b, so that exactly the format's values are
covered, and goes through a Feistel network whose rounds add a keyed SHA-256 of the one to the other, modulo
a and b in turns. That is a permutation of the format: equal values get equal pseudonyms in all documents,
different values different ones, and a pseudonym is valid again. Separators, widths, letter case, the first
digit of cards, country codes and mail domains stay. restore() undoes it with the same key.

Other text is untouched, byte by byte. Null texts stay null, and have 0 of each kind; empty ones stay empty. Very long
texts and values take time in proportion to their length. Each row stands alone: repeated rows and equal values are
replaced alike, and there are no ties. An empty table gives an empty one. Of other columns only one named pii is
replaced. Dates with slashes are month/day if that is a date, else day/month; the latter can't always be restored, all
else can.

The key is a column of a frame of one row, which joins the documents: plans, the UI and event logs show its name, not its value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

ROUNDS = 10
#: Characters of a mail name that go through the network together; up to 18 digits or 22 letters fit.
MAIL_CHUNK = 18
KINDS = ("email", "iban", "date", "ip", "phone", "ssn", "card")
_PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4})(?![0-9A-SU-Za-z/-]|T(?![0-9]))",
    "ip": r"(?<![0-9A-Za-z.:])(?:(?:(?:0|[1-9][0-9]{0,2})\.){3}(?:0|[1-9][0-9]{0,2})(?![0-9A-Za-z]|\.[0-9])|(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Za-z:]|\.[0-9]))",
    "phone": r"(?<![0-9A-Za-z+])(?:(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,4})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|(?:[0-9]{4}[ .-]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])",
}
PATTERN = "|".join(_PATTERNS[k] for k in KINDS)


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _all(pattern: str) -> str:
    return _quoted(f"^(?:{pattern})$")


class _Feistel:
    """Writes the network's SQL for one direction and the key, which is the SQL of a column."""

    def __init__(self, key: str, back: bool):
        self.key, self.back = key, back

    def pair(self, kind: str, left: str, right: str, a: str, b: str) -> str:
        """A struct (l, r): where (left, right), below (a, b), goes. ``kind`` is SQL for the format's name."""
        f = lambda half: f"(cast(conv(substr(sha2(concat({self.key}, '|', {kind}, '|', i, '|', {half}), 256), 1, 15), 16, 10) as bigint))"
        step = lambda x, m, half: f"(({m} + {x} - {f(half)} % {m}) % {m})" if self.back else f"(({x} + {f(half)} % {m}) % {m})"
        turns = f"sequence({ROUNDS - 1}, 0, -1)" if self.back else f"sequence(0, {ROUNDS - 1})"
        return (
            f"aggregate({turns}, named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> "
            f"if(i % 2 = 0, named_struct('l', {step('s.l', a, 's.r')}, 'r', s.r), named_struct('l', s.l, 'r', {step('s.r', b, 's.l')})))"
        )

    def digits(self, kind: str, d: str) -> str:
        """A string of digits, 1 to 36 of them, as another of the same length."""
        u, v = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
        power = lambda n: f"cast(rpad('1', {n} + 1, '0') as bigint)"
        pair = self.pair(f"concat({kind}, length({d}))", f"if({u} = 0, 0, cast(concat('0', substr({d}, 1, {u})) as bigint))", f"cast(substr({d}, {u} + 1) as bigint)", power(u), power(v))
        return _let("p", pair, f"concat(if({u} = 0, '', lpad(cast(p.l as string), {u}, '0')), lpad(cast(p.r as string), {v}, '0'))")

    def letters(self, kind: str, w: str, base: int = 26) -> str:
        """A string of the first ``base`` letters, 1 to 22 of a-z or 48 of a-f, as another of the same length."""
        u, v = f"(length({w}) div 2)", f"(length({w}) - length({w}) div 2)"
        number = lambda s: f"aggregate(filter(split({s}, ''), c -> c <> ''), 0L, (n, c) -> n * {base} + ascii(c) - 97)"
        spelt = lambda x, n: f"if({n} = 0, '', aggregate(sequence(1, greatest(1, {n})), named_struct('o', '', 'x', {x}), (s, i) -> named_struct('o', concat(char(97 + s.x % {base}), s.o), 'x', s.x div {base}), s -> s.o))"
        power = lambda n: f"aggregate(sequence(1, greatest(1, {n})), 1L, (q, i) -> if({n} = 0, 1L, q * {base}))"
        pair = self.pair(f"concat({kind}, length({w}))", number(f"substr({w}, 1, {u})"), number(f"substr({w}, {u} + 1)"), power(u), power(v))
        return _let("p", pair, f"concat({spelt('p.l', u)}, {spelt('p.r', v)})")


def _digits_of(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _refill(m: str, d: str) -> str:
    """The string m with its digits, in order, replaced by those of d."""
    return f"aggregate(split({m}, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c rlike '^[0-9]$', named_struct('o', concat(s.o, substr({d}, s.k, 1)), 'k', s.k + 1), named_struct('o', concat(s.o, c), 'k', s.k)), s -> s.o)"


def _luhn(d: str) -> str:
    """The sum of a digit string by Luhn, without its last digit, which is doubled from there on."""
    return (
        f"aggregate(sequence(1, length({d}) - 1), 0, (t, i) -> t + {_let('y', f'cast(substr({d}, length({d}) - i, 1) as int)', 'if(i % 2 = 1, if(y > 4, 2 * y - 9, 2 * y), y)')})"
    )


def _mod97(s: str) -> str:
    return f"aggregate(filter(split({s}, ''), c -> c <> ''), 0, (n, c) -> if(c rlike '^[0-9]$', (n * 10 + cast(c as int)) % 97, (n * 100 + ascii(c) - 55) % 97))"


def _rules(f: _Feistel) -> dict[str, str]:
    """For each kind SQL of the candidate m: its pseudonym, or null where it isn't valid."""
    card = _let(
        "d", _digits_of("m"),
        f"CASE WHEN length(d) BETWEEN 13 AND 19 AND ({_luhn('d')} + cast(right(d, 1) as int)) % 10 = 0 THEN "
        + _let("e", f"concat(left(d, 1), {f.digits(_quoted('card'), 'substr(d, 2, length(d) - 2)')}, '0')", _let("g", f"concat(left(e, length(e) - 1), cast((10 - {_luhn('e')} % 10) % 10 as string))", _refill("m", "g")))
        + " END",
    )
    iban = _let(
        "t", "replace(m, ' ', '')",
        f"CASE WHEN length(t) BETWEEN 15 AND 34 AND {_mod97('concat(substr(t, 5), left(t, 4))')} = 1 AND length({_digits_of('substr(t, 5)')}) >= 2 THEN "
        + _let("d", _digits_of("substr(t, 5)"), _let("e", f.digits(_quoted("iban"), "d"), _let("g", _refill("substr(t, 5)", "e"), _let("z", f"lpad(cast(98 - {_mod97("concat(g, left(t, 2), '00')")} as string), 2, '0')",
            "aggregate(split(m, ''), named_struct('o', '', 'k', 1), (s, c) -> if(c = ' ', named_struct('o', concat(s.o, c), 'k', s.k), named_struct('o', concat(s.o, substr(concat(left(t, 2), z, g), s.k, 1)), 'k', s.k + 1)), s -> s.o)"))))
        + " END",
    )
    shape = "CASE WHEN m LIKE '%-%' THEN 'y-M-d' WHEN m LIKE '%.%' THEN 'd.M.y' WHEN try_to_date(m, 'M/d/y') IS NOT NULL THEN 'M/d/y' ELSE 'd/M/y' END"
    out = "replace(replace(replace({0}, 'y', 'yyyy'), 'M', if({1}, 'MM', 'M')), 'd', if({1}, 'dd', 'd'))".format("w", "m rlike '^0|[./-]0|^[0-9]{2}[./][0-9]{2}[./]|^[0-9]{4}-'")
    date = _let(
        "w", shape,
        _let("t", "try_to_date(m, w)", "CASE WHEN year(t) BETWEEN 1900 AND 2099 THEN " + _let("n", "datediff(t, date'1900-01-01')", _let("p", f.pair(_quoted("date"), "n div 4297", "n % 4297", "17L", "4297L"), f"date_format(date_add(date'1900-01-01', cast(p.l * 4297 + p.r as int)), {out})")) + " END"),
    )
    v4 = _let(
        "o", "transform(split(m, '[.]'), x -> cast(x as int))",
        "CASE WHEN forall(o, x -> x < 256) THEN " + _let("p", f.pair(_quoted("ip"), "o[0] * 256 + o[1]", "o[2] * 256 + o[3]", "65536L", "65536L"), "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)") + " END",
    )
    spelt = lambda h: (  # noqa: E731  its letters and digits, in order, replaced by those of e and g
        f"aggregate(split({h}, ''), named_struct('o', '', 'j', 1, 'k', 1), (s, c) -> CASE WHEN c rlike '^[0-9]$' THEN named_struct('o', concat(s.o, substr(g, s.k, 1)), 'j', s.j, 'k', s.k + 1) "
        "WHEN c rlike '^[a-z]$' THEN named_struct('o', concat(s.o, substr(e, s.j, 1)), 'j', s.j + 1, 'k', s.k) WHEN c rlike '^[A-Z]$' THEN named_struct('o', concat(s.o, upper(substr(e, s.j, 1))), 'j', s.j + 1, 'k', s.k) "
        "ELSE named_struct('o', concat(s.o, c), 'j', s.j, 'k', s.k) END, s -> s.o)"
    )
    parts = lambda h, kind, base: _let("w", f"regexp_replace(lower({h}), '[^a-z]', '')", _let("d", _digits_of(h), _let("e", f"if(w = '', '', {f.letters(kind, 'w', base)})", _let("g", f"if(d = '', '', {f.digits(kind, 'd')})", spelt(h)))))
    groups = "filter(split(m, ':'), x -> x <> '')"
    v6 = f"CASE WHEN m rlike '[0-9]' AND size({groups}) BETWEEN 2 AND if(m LIKE '%::%', 7, 8) AND exists({groups}, x -> length(x) >= 3) THEN {parts('m', _quoted('ip6-'), 6)} END"
    ip = f"CASE WHEN m LIKE '%:%' THEN {v6} ELSE {v4} END"
    ssn = _let(
        "d", _digits_of("m"),
        "CASE WHEN NOT left(d, 3) IN ('000', '666') AND left(d, 1) <> '9' AND substr(d, 4, 2) <> '00' AND right(d, 4) <> '0000' THEN "
        + _let("n", "cast(left(d, 3) as int)", _let("p", f.pair(_quoted("ssn"), "n - 1 - if(n > 666, 1, 0)", "(cast(substr(d, 4, 2) as bigint) - 1) * 9999 + cast(right(d, 4) as bigint) - 1", "898L", "989901L"),
            "concat(lpad(cast(p.l + 1 + if(p.l >= 665, 1, 0) as string), 3, '0'), '-', lpad(cast(p.r div 9999 + 1 as string), 2, '0'), '-', lpad(cast(p.r % 9999 + 1 as string), 4, '0'))"))
        + " END",
    )
    phone = _let(
        "d", _digits_of("m"),
        _let("n", "right(d, 10)", "CASE WHEN NOT length(d) BETWEEN 8 AND 15 THEN NULL WHEN (length(d) = 10 AND m NOT LIKE '+%' OR length(d) = 11 AND left(d, 1) = '1') AND n rlike '^[2-9][0-9]{2}[2-9]' THEN "
        + _let("p", f.pair(_quoted("phone"), "(cast(left(n, 1) as int) - 2) * 100 + cast(substr(n, 2, 2) as int)", "((cast(substr(n, 4, 1) as bigint) - 2) * 100 + cast(substr(n, 5, 2) as bigint)) * 10000 + cast(right(n, 4) as bigint)", "800L", "8000000L"),
            _let("g", "concat(left(d, length(d) - 10), cast(p.l div 100 + 2 as string), lpad(cast(p.l % 100 as string), 2, '0'), cast(p.r div 1000000 + 2 as string), lpad(cast(p.r % 1000000 as string), 6, '0'))", _refill("m", "g")))
        + " WHEN length(d) >= 10 THEN " + _let("g", f"concat(left(d, length(d) - 9), {f.digits(_quoted('far'), 'right(d, 9)')})", _refill("m", "g"))
        + " ELSE " + _let("g", f"concat(left(d, 2), {f.digits(_quoted('far'), 'substr(d, 3)')})", _refill("m", "g")) + " END"),
    )
    # A mail name goes in chunks, each with its letters as one word and its digits as another; so names of any length take
    # time in proportion.
    kind = "concat('mail', n, '-')"
    chunk = parts("h", kind, 26)
    email = _let("q", "substring_index(m, '@', 1)", f"concat(array_join(transform(regexp_extract_all(q, '.{{1,{MAIL_CHUNK}}}', 0), (h, n) -> {chunk}), ''), substr(m, length(q) + 1))")
    return {"email": email, "iban": iban, "date": date, "ip": ip, "phone": phone, "ssn": ssn, "card": card}


def _found(text: str, key: str, back: bool) -> Column:
    """array<struct<kind, old, new>> of all candidates; new is null where one isn't valid. ``key`` is a column."""
    rules = _rules(_Feistel(f"`{key}`", back))
    kind = "CASE " + " ".join(f"WHEN m rlike {_all(_PATTERNS[k])} THEN '{k}'" for k in KINDS) + " END"
    new = "CASE x.kind " + " ".join(f"WHEN '{k}' THEN {_let('m', 'x.old', rules[k])}" for k in KINDS) + " END"
    each = _let("x", f"named_struct('kind', {kind}, 'old', m)", f"named_struct('kind', x.kind, 'old', x.old, 'new', {new})")
    return F.expr(f"CASE WHEN `{text}` rlike '[0-9@]' THEN transform(regexp_extract_all(`{text}`, {_quoted(PATTERN)}, 0), m -> {each}) ELSE array() END")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with its text column pseudonymised and a column pii, array<struct<kind, old, new>> of what was
    replaced. A column pii of ``docs`` is replaced."""
    name = fresh([*docs.columns, "pii"], "key")
    keys = docs.sparkSession.createDataFrame([(key,)], f"`{name}` string")
    found = docs.join(F.broadcast(keys)).withColumn("pii", _found(text_col, name, back)).drop(name)
    gaps = f"split(`{text_col}`, {_quoted(PATTERN)}, -1)"
    told = f"CASE WHEN size(pii) = 0 THEN `{text_col}` ELSE array_join(transform({gaps}, (g, k) -> concat(g, CASE WHEN k < size(pii) THEN coalesce(pii[k].new, pii[k].old) ELSE '' END)), '') END"
    return found.withColumn(text_col, F.expr(told)).withColumn("pii", F.expr("filter(coalesce(pii, array()), x -> x.new IS NOT NULL)"))


def restore(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The inverse of pseudonymise() with the same key."""
    return pseudonymise(docs, key, text_col, back=True)
