"""Format-preserving pseudonyms for personal data, in DataFrame expressions.

One pattern finds candidates; validated numbers (payment cards, IBANs, IPv4
addresses, social security numbers, phone numbers) and dates are permuted by
a keyed Feistel network over exactly their own set of valid values, so a
pseudonym is valid in the same format, two equal values get the same
pseudonym in every document, and two different ones never do.  Mail
addresses and secrets, which have no small format to permute in, become a
keyed digest, equal for equal values, repeated to the length of a secret or
hexadecimal value.  Candidates that fail validation (a
long number that is no card, a 13th month) stay as they are.

The text is split at the matches and put together again around the
pseudonyms.  There is no shuffle and no Python on the executors.

Defined cases: null text stays null with zero counts; empty text stays
empty; other columns pass through ``pseudonymise`` untouched, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Production deployments pass their own key; equal keys give linkable output.
DEMO_KEY = "riskfold-demo-key"
ROUNDS = 10

# ---------------------------------------------------------------------------
# How many characters an IBAN of a country has.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}
# ---------------------------------------------------------------------------

_BY_COUNTRY = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())

#: A secret's key, sign and opening quote.
_KEY = r"(?i:token|secret|password|passwd|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}"

#: What is looked for, in order: the first alternative that fits wins.
PATTERNS = {
    # the whole value, however long: up to its closing quote on the line, or, if there is none, to white space; without
    # quotes, what has a digit, up to white space, a quote or a comma.  Possessive, so nothing recurses
    "secret": _KEY + r"(?:\"(?:[^\"\r\n]{8,}+(?=\")|[^\"\s]{8,}+)|'(?:[^'\r\n]{8,}+(?=')|[^'\s]{8,}+)"
              r"|(?=[^\s\"',;0-9]*+[0-9])[^\s\"',;]{8,}+)",
    # a domain name has 127 labels at most
    "mail": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,126}",
    # as long as its country's are, whatever follows; of other countries, up to the end of the groups
    "iban": r"(?<![\p{L}\p{N}])(?=[A-Z]{2}[0-9]{2})(?:(?:" + _BY_COUNTRY + r")(?![\p{L}\p{N}])"
            r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "date": r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
            r"|(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])|(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?!\.?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
             r"|(?<![0-9])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}|[0-9]{13,19})(?![0-9])",
    "hex": r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,}+(?![\p{L}\p{N}])",
}
ANY = "|".join(PATTERNS.values())
#: What stands before a secret's value: key, sign and opening quote.
SECRET_KEY = r"^[^=:]*[=:]\s{0,3}[\"']?"

#: Days of one block of dates: dates are permuted inside their block.  Blocks
#: start at 0001-01-01; the last, shorter one ends at 9999-12-31.
DATE_LEFT, DATE_RIGHT = 250, 292
LAST_LEFT, LAST_RIGHT = 29, 71
_BLOCK = DATE_LEFT * DATE_RIGHT
_LAST = 3_652_059 // _BLOCK


def _q(text: str) -> str:
    """A raw SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _luhn(d: str) -> str:
    """Luhn sum modulo 10 of a digit string; the last digit counts once."""
    digit = f"cast(substring({d}, -k, 1) as int)"
    return (f"aggregate(sequence(1, length({d})), 0, (acc, k) -> acc + if(k % 2 = 1, {digit}, "
            f"if({digit} > 4, 2 * {digit} - 9, 2 * {digit}))) % 10")


def _mod97(s: str) -> str:
    """An IBAN's text, moved and spelt as digits, modulo 97."""
    alphabet = "'0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
    moved = f"concat(substring({s}, 5), substring({s}, 1, 4))"
    value = f"(instr({alphabet}, substring({moved}, k, 1)) - 1)"
    return (f"aggregate(sequence(1, length({s})), 0, (acc, k) -> (acc * if({value} > 9, 100, 10) + {value}) % 97)")


def _kind(m: str, d: str, day: str) -> str:
    """The kind of a match ``m`` with digits ``d``; null if it fails validation."""
    whole = {k: _q(f"^(?:{p})$") for k, p in PATTERNS.items()}
    octets = f"forall(split({m}, '[.]'), o -> cast(o as int) <= 255)"
    ssn = (f"substring({d}, 1, 3) not in ('000', '666') and substring({d}, 1, 1) <> '9' "
           f"and substring({d}, 4, 2) <> '00' and substring({d}, 6) <> '0000'")
    iban = f"regexp_replace({m}, ' ', '')"
    tests = [
        ("secret", f"{m} rlike {_q('^' + _KEY)}"),
        ("mail", f"instr({m}, '@') > 0"),
        ("ip", f"{m} rlike {whole['ip']} and {octets}"),
        ("date", f"{day} is not null"),
        ("ssn", f"{m} rlike {whole['ssn']} and {ssn}"),
        ("phone", f"{m} rlike {whole['phone']} and length({d}) between 8 and 18"),
        ("card", f"{m} rlike {whole['card']} and length({d}) between 13 and 19 and {_luhn(d)} = 0"),
        ("iban", f"{m} rlike {whole['iban']} and length({iban}) between 15 and 34 and length({d}) between 6 and 32 and {_mod97(iban)} = 1"),
        ("hex", f"{m} rlike {whole['hex']} and {m} rlike '[0-9]'"),
    ]
    return "case " + " ".join(f"when {t} then '{k}'" for k, t in tests) + " end"


def _order(m: str) -> str:
    """How a date is written: ymd, dmy or mdy, and its separator."""
    sign = f"substring(regexp_extract({m}, '[/.-]', 0), 1, 1)"
    return f"concat(case when {m} rlike '^[0-9]{{4}}-' then 'ymd' when try_cast(get(split({m}, '[/.]'), 1) as int) <= 12 then 'dmy' else 'mdy' end, {sign})"


def _day(m: str) -> str:
    """Days since 0001-01-01 of a match that reads as a date, or null."""
    p = f"split({m}, '[/.]')"
    two = lambda i: f"lpad(get({p}, {i}), 2, '0')"
    iso = (f"case when {m} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$' then {m} "
           f"when not {m} rlike '^[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.][0-9]{{4}}$' then null "
           f"when try_cast(get({p}, 1) as int) <= 12 then concat_ws('-', get({p}, 2), {two(1)}, {two(0)}) else concat_ws('-', get({p}, 2), {two(0)}, {two(1)}) end")
    return f"datediff(cast(try_to_timestamp({iso}, 'yyyy-MM-dd') as date), date'0001-01-01')"


def _halves() -> str:
    """l, r and their moduli a, b for the Feistel network of a kind."""
    def digits(s: str) -> tuple[str, str, str, str]:
        n = f"length({s})"
        return (f"cast(substring({s}, 1, {n} div 2) as bigint)", f"cast(substring({s}, {n} div 2 + 1) as bigint)",
                f"cast(pow(10, {n} div 2) as bigint)", f"cast(pow(10, {n} - {n} div 2) as bigint)")

    octet = lambda i: f"cast(split(x.m, '[.]')[{i}] as bigint)"
    inside = f"(x.day % {_BLOCK})"
    right = f"if(x.day div {_BLOCK} = {_LAST}, {LAST_RIGHT}, {DATE_RIGHT})"
    left = f"if(x.day div {_BLOCK} = {_LAST}, {LAST_LEFT}, {DATE_LEFT})"
    area = "cast(substring(x.d, 1, 3) as bigint)"
    rows = {
        "ip": (f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536L", "65536L"),
        "date": (f"cast({inside} div {right} as bigint)", f"cast({inside} % {right} as bigint)", f"cast({left} as bigint)", f"cast({right} as bigint)"),
        # 898 areas (001 to 899 without 666), 99 groups, 9999 serials
        "ssn": (f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substring(x.d, 4, 2) as bigint) - 1",
                "cast(substring(x.d, 6) as bigint) - 1", "cast(898 * 99 as bigint)", "9999L"),
        "phone": digits("x.own"), "card": digits("x.own"), "iban": digits("x.own"),
    }
    pick = lambda i, other: "case x.kind " + " ".join(f"when '{k}' then {v[i]}" for k, v in rows.items()) + f" else {other} end"
    return f"struct(x.m as m, x.d as d, x.day as day, x.kind as kind, x.own as own, {pick(0, '0L')} as l, {pick(1, '0L')} as r, {pick(2, '1L')} as a, {pick(3, '1L')} as b)"


def _permuted(key: str) -> str:
    """The Feistel network: rounds change the halves in turn."""
    def added(half: str, by: str, modulus: str) -> str:
        digest = f"sha2(concat_ws('|', {_q(key)}, y.kind, cast(length(y.own) as string), cast(coalesce(y.day, 0) div {_BLOCK} as string), cast(i as string), cast(s.{by} as string)), 256)"
        return f"(s.{half} + cast(conv(substring({digest}, 1, 15), 16, 10) as bigint)) % y.{modulus}"

    return (f"aggregate(sequence(1, {ROUNDS}), struct(y.l as l, y.r as r), (s, i) -> if(i % 2 = 1, "
            f"struct({added('l', 'r', 'a')} as l, s.r as r), struct(s.l as l, {added('r', 'l', 'b')} as r)))")


def _written(key: str) -> str:
    """The pseudonym of z: what was found, with the permuted halves z.l, z.r."""
    half = "length(z.own) div 2"
    own = f"concat(lpad(cast(z.l as string), {half}, '0'), lpad(cast(z.r as string), length(z.own) - {half}, '0'))"
    fill = lambda digits, skip: (  # noqa: E731  digits in the places of the old ones, after the first ``skip``
        f"array_join(transform(sequence(1, length(z.m)), k -> if(substring(z.m, k, 1) rlike '[0-9]' and "
        f"length(regexp_replace(substring(z.m, 1, k), '[^0-9]', '')) > {skip}, "
        f"substring({digits}, length(regexp_replace(substring(z.m, 1, k), '[^0-9]', '')) - {skip}, 1), substring(z.m, k, 1))), '')")
    date = f"date_add(date'0001-01-01', cast((z.day div {_BLOCK}) * {_BLOCK} + z.l * z.b + z.r as int))"
    layout = "case substring(z.written, 1, 3) when 'ymd' then 'yyyy-MM-dd' when 'dmy' then concat('dd', substring(z.written, 4), 'MM', substring(z.written, 4), 'yyyy') else concat('MM', substring(z.written, 4), 'dd', substring(z.written, 4), 'yyyy') end"
    area = "(z.l div 99 + 1 + if(z.l div 99 + 1 >= 666, 1, 0))"
    ssn = f"concat(lpad(cast({area} as string), 3, '0'), '-', lpad(cast(z.l % 99 + 1 as string), 2, '0'), '-', lpad(cast(z.r + 1 as string), 4, '0'))"
    card = f"concat({own}, cast((10 - {_luhn(f'concat({own}, {_q('0')})')}) % 10 as string))"
    body = fill(own, "2")
    iban0 = f"concat(substring(z.m, 1, 2), '00', substring({body}, 5))"
    check = f"98 - {_mod97(f'regexp_replace({iban0}, {_q(" ")}, {_q("")})')}"
    iban = f"concat(substring(z.m, 1, 2), lpad(cast({check} as string), 2, '0'), substring({body}, 5))"
    digest = lambda s: f"sha2(concat_ws('|', {_q(key)}, z.kind, {s}), 256)"
    before = f"regexp_extract(z.m, {_q(SECRET_KEY)}, 0)"
    value = f"substring(z.m, length({before}) + 1)"
    secret = f"concat({before}, substring(repeat({digest(value)}, length({value}) div 64 + 1), 1, length({value})))"
    cases = {
        "secret": secret,
        "mail": f"concat('u', substring({digest('lower(z.m)')}, 1, 16), '@example.invalid')",
        "ip": "concat_ws('.', cast(z.l div 256 as string), cast(z.l % 256 as string), cast(z.r div 256 as string), cast(z.r % 256 as string))",
        "date": f"date_format({date}, {layout})",
        "ssn": ssn,
        "phone": fill(own, "(length(z.d) - length(z.own))"),
        "card": fill(card, "0"),
        "iban": iban,
        "hex": f"substring(repeat({digest('lower(z.m)')}, length(z.m) div 64 + 1), 1, length(z.m))",
    }
    return "case z.kind " + " ".join(f"when '{k}' then {v}" for k, v in cases.items()) + " else z.m end"


def _pseudonyms(key: str, matches: str) -> str:
    """SQL: an array of structs (kind, put) for the array of matches.  Each
    step is its own ``transform``, so nothing is written out twice."""
    found = f"transform({matches}, m -> struct(m as m, regexp_replace(m, '[^0-9]', '') as d, {_day('m')} as day))"
    kinds = f"transform({found}, w -> struct(w.m as m, w.d as d, w.day as day, {_kind('w.m', 'w.d', 'w.day')} as kind))"
    # the digits that are permuted: a card without its check digit, a phone
    # number without its country code, an IBAN without its check digits
    code = "length(regexp_replace(regexp_extract(w.m, '^[+][0-9]{1,3}(?=[ .(-])', 0), '[^0-9]', ''))"
    own = (f"case w.kind when 'card' then substring(w.d, 1, length(w.d) - 1) when 'phone' then substring(w.d, {code} + 1) "
           "when 'iban' then substring(w.d, 3) else '' end")
    owned = f"transform({kinds}, w -> struct(w.m as m, w.d as d, w.day as day, w.kind as kind, {own} as own))"
    halves = f"transform({owned}, x -> {_halves()})"
    moved = f"transform({halves}, y -> struct(y as y, {_permuted(key)} as p))"
    flat = (f"transform({moved}, v -> struct(v.y.m as m, v.y.d as d, v.y.day as day, v.y.kind as kind, v.y.own as own, v.y.b as b, "
            f"v.p.l as l, v.p.r as r, {_order('v.y.m')} as written))")
    return f"transform({flat}, z -> struct(z.kind as kind, {_written(key)} as put))"


def pseudonymise(docs: DataFrame, key: str = DEMO_KEY, column: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with its text pseudonymised, and (with ``counts``) the columns
    n_numbers, n_dates and n_other: how many values of each sort were replaced."""
    own = {c.lower() for c in docs.columns}
    fresh = lambda name: name if name.lower() not in own else fresh("_" + name)
    found, put = fresh("_found"), fresh("_put")
    df = docs.withColumn(found, F.regexp_extract_all(F.col(column), F.lit(ANY), F.lit(0)))
    df = df.withColumn(put, F.when(F.size(found) > 0, F.expr(_pseudonyms(key, f"`{found}`"))))
    joined = F.expr(f"array_join(zip_with(split(`{column}`, {_q(ANY)}, -1), transform(`{put}`, z -> z.put), (p, q) -> concat(p, coalesce(q, ''))), '')")
    df = df.withColumn(column, F.when(F.col(put).isNull(), F.col(column)).otherwise(joined))
    if counts:
        of = lambda kinds: F.coalesce(F.expr(f"size(filter(`{put}`, z -> z.kind in ({kinds})))"), F.lit(0))
        df = df.withColumns({"n_numbers": of("'card', 'iban', 'ip', 'ssn', 'phone'"), "n_dates": of("'date'"), "n_other": of("'mail', 'secret', 'hex'")})
    return df.drop(found, put)
