"""Pseudonyms against a plain Python version, and the permutations' properties."""

from __future__ import annotations

import datetime as dt
import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from riskfold.llm import pii
from riskfold.llm.queries import op2_pii_pseudonyms
from tests.conftest import SF_MID, SF_SMALL
from tests.llm.helpers import docs

KEY = pii.DEMO_KEY


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def feistel(kind, size, block, left, right, a, b):
    for i in range(1, 11):
        half = right if i % 2 else left
        h = int(hashlib.sha256("|".join([KEY, kind, str(size), str(block), str(i), str(half)]).encode()).hexdigest()[:15], 16)
        if i % 2:
            left = (left + h) % a
        else:
            right = (right + h) % b
    return left, right


def permute_digits(kind, own):
    n = len(own) // 2
    left, right = feistel(kind, len(own), 0, int(own[:n] or 0), int(own[n:]), 10 ** n, 10 ** (len(own) - n))
    return str(left).zfill(n) * bool(n) + str(right).zfill(len(own) - n)


def refill(text, digits, skip):
    out, seen = [], 0
    for c in text:
        if c in "0123456789":
            seen += 1
            c = digits[seen - skip - 1] if seen > skip else c
        out.append(c)
    return "".join(out)


def digest(kind, value):
    return hashlib.sha256(f"{KEY}|{kind}|{value}".encode()).hexdigest()


def as_date(m):
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", m):
        y, mo, d = map(int, m.split("-"))
        layout = "%Y-%m-%d"
    elif re.fullmatch(r"\d{1,2}([/.])\d{1,2}\1\d{4}", m):
        sep = "/" if "/" in m else "."
        d, mo, y = map(int, m.split(sep))
        layout = sep.join(["%d", "%m", "%Y"])
        if mo > 12:
            d, mo, layout = mo, d, sep.join(["%m", "%d", "%Y"])
    else:
        return None
    try:
        return dt.date(y, mo, d), layout
    except ValueError:
        return None


def whole(kind, m):
    return regex.fullmatch(pii.PATTERNS[kind], m) is not None


def plain(m):
    """(kind, pseudonym) of one match."""
    d = re.sub("[^0-9]", "", m)
    if regex.match(pii._KEY, m):
        before = re.match("[^=:]*[=:]\\s{0,3}[\"']?", m)[0]
        value = m[len(before):]
        return "secret", before + (digest("secret", value) * (len(value) // 64 + 1))[:len(value)]
    if "@" in m:
        return "mail", "u" + digest("mail", m.lower())[:16] + "@example.invalid"
    if whole("ip", m) and all(int(x) <= 255 for x in m.split(".")):
        o = [int(x) for x in m.split(".")]
        left, right = feistel("ip", 0, 0, o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return "ip", ".".join(map(str, [*divmod(left, 256), *divmod(right, 256)]))
    if found := as_date(m):
        day = (found[0] - dt.date(1, 1, 1)).days
        block, inside = divmod(day, pii._BLOCK)
        a, b = (29, 71) if block == pii._LAST else (250, 292)
        left, right = feistel("date", 0, block, inside // b, inside % b, a, b)
        new = dt.date(1, 1, 1) + dt.timedelta(days=block * pii._BLOCK + left * b + right)
        return "date", new.strftime(found[1].replace("%Y", f"{new.year:04d}"))
    if whole("ssn", m) and d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000":
        area = int(d[:3])
        left, right = feistel("ssn", 0, 0, (area - 1 - (area > 666)) * 99 + int(d[3:5]) - 1, int(d[5:]) - 1, 898 * 99, 9999)
        area = left // 99 + 1
        return "ssn", f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if whole("phone", m) and 8 <= len(d) <= 18:
        code = re.match(r"[+]\d{1,3}(?=[ .(-])", m)
        skip = len(code[0]) - 1 if code else 0
        return "phone", refill(m, permute_digits("phone", d[skip:]), skip)
    if whole("card", m) and 13 <= len(d) <= 19 and luhn(d) == 0:
        new = permute_digits("card", d[:-1])
        return "card", refill(m, new + str((10 - luhn(new + "0")) % 10), 0)
    if whole("iban", m):
        bare = m.replace(" ", "")
        if 15 <= len(bare) <= 34 and 6 <= len(d) <= 32 and mod97(bare) == 1:
            body = refill(m, permute_digits("iban", d[2:]), 2)
            check = 98 - mod97(bare[:2] + "00" + body[4:].replace(" ", ""))
            return "iban", m[:2] + f"{check:02d}" + body[4:]
    if whole("hex", m) and re.search("[0-9]", m):
        return "hex", (digest("hex", m.lower()) * (len(m) // 64 + 1))[:len(m)]
    return None, m


def brute(text):
    if text is None:
        return None, []
    kinds = []

    def put(match):
        kind, new = plain(match[0])
        kinds.append(kind)
        return new

    return regex.sub(pii.ANY, put, text), [k for k in kinds if k]


CASES = [
    "card 4556737586899855, 4556 7375 8689 9855 and no card 4556737586899856; 378282246310005",
    "ssn 123-45-6789 not 666-12-1234 or 900-11-2222 and 000-12-1234, 899-99-9999",
    "ip 1.2.3.4 and 255.255.255.255. Not 256.1.1.1 or 1.2.3.4.5",
    "iban DE89370400440532013000 or GB82 WEST 1234 5698 7654 32, not DE88370400440532013000",
    "dates 2024-02-29 2023-02-29 31/12/1999 12/31/1999 1.2.2003 01.02.2003 9999-12-31 0001-01-01 31.02.2003 2024-13-01 00/00/2000",
    "phones +1 (017) 555-7713, (212) 555-0100 212-555-0100 +44 20 7946 0958 +4915112345678",
    "mail Ann.Lee@mail7.example.com, é.x@a.de; not @x.com a@b",
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: \'hunter2hunter2\' api_key="short"',
    "24be64439e3e49cf46b2d7c90f3602a3d0b907ff xdeadbeef " + "deadbeef" * 4 + " " + "1" * 19 + " " + "7" * 32,
    "", None, " ", "plain text 12 345 2020", "ab" * 30_000 + " 1.2.3.4", "4556737586899855\n1.2.3.4$$$### 4556737586899855***",
    "+1 (017) 555-7713 again", "12345678901234567890123 4556737586899855-1", "\\ ' \" $1 1.2.3.4 \\1 $0",
]


def test_cases_against_plain_version(spark):
    rows = pii.pseudonymise(docs(spark, CASES)).orderBy("doc_id").collect()
    for row, text in zip(rows, CASES, strict=True):
        want, kinds = brute(text)
        assert row.text == want, text
        assert row.n_numbers == sum(k in ("card", "iban", "ip", "ssn", "phone") for k in kinds)
        assert row.n_dates == kinds.count("date")
        assert row.n_other == sum(k in ("mail", "secret", "hex") for k in kinds)


def test_all_documents_against_plain_version(spark):
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id", "text").collect()}
    rows = op2_pii_pseudonyms(spark, SF_MID).collect()
    assert len(rows) == len(src)
    for r in rows:
        want, kinds = brute(src[r.doc_id])
        assert r.text == want and r.n_numbers + r.n_dates + r.n_other == len(kinds)


def test_no_python_and_no_shuffle(spark):
    plan = op2_pii_pseudonyms(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("kind,a,b", [("ssn", 7, 5), ("ip", 16, 16), ("date", 25, 29)])
def test_rounds_are_a_permutation(kind, a, b):
    out = {feistel(kind, 0, 0, x, y, a, b) for x in range(a) for y in range(b)}
    assert len(out) == a * b


def test_pseudonyms_stay_valid_and_linked():
    cards = [plain(c)[1] for c in ("4556737586899855", "378282246310005")]
    assert all(luhn(c) == 0 for c in cards) and [len(c) for c in cards] == [16, 15]
    assert mod97(plain("GB82 WEST 1234 5698 7654 32")[1].replace(" ", "")) == 1
    days = [dt.date(2001, 1, 1) + dt.timedelta(days=i) for i in range(3000)]
    new = {plain(d.isoformat())[1] for d in days}
    assert len(new) == 3000 and all(dt.date.fromisoformat(x) for x in new)
    assert plain("05/03/2020")[1] == plain("5/3/2020")[1]


def test_columns_pass_through(spark):
    d = docs(spark, ["1.2.3.4", None]).withColumn("_found", F.lit("mine")).withColumn("D", F.lit(1)).withColumn("kind", F.lit("k"))
    out = pii.pseudonymise(d, counts=False)
    assert out.columns == d.columns and {r._found for r in out.collect()} == {"mine"}
    assert pii.pseudonymise(d.limit(0)).count() == 0
    assert pii.pseudonymise(d, key="other").first().text != out.first().text


def test_secrets_go_whole(spark):
    """Expected texts are written without the module's pattern."""
    def gone(value):
        return (hashlib.sha256(f"riskfold-demo-key|secret|{value}".encode()).hexdigest() * (len(value) // 64 + 1))[:len(value)]

    a, b, c = "A7-_." * 200, "A7-_." * 199 + "A7-_x", "é😀" * 20_000
    texts = [f'x token = "{a}" y', f"token='{b}'", f'{{"password": "hunter2hunter2", "n": 1}} {{\'api_key\' : \'{a}\'}}',
             f'secret="{c} tail"', 'password: "it\'s_a_secret" z', 'token = "' + "k" * 64 + '"', '"token": "short"']
    want = [f'x token = "{gone(a)}" y', f"token='{gone(b)}'", f'{{"password": "{gone("hunter2hunter2")}", "n": 1}} {{\'api_key\' : \'{gone(a)}\'}}',
            f'secret="{gone(c + " tail")}"', f'password: "{gone("it\'s_a_secret")}" z', 'token = "' + gone("k" * 64) + '"', '"token": "short"']
    rows = pii.pseudonymise(docs(spark, texts)).orderBy("doc_id").collect()
    assert [r.text for r in rows] == want and gone(a) != gone(b)
    assert [r.n_other for r in rows] == [1, 1, 2, 1, 1, 1, 0]


def test_nothing_of_these_stays_in_clear(spark):
    """Expected texts by hand: digests and permuted digits are recomputed from
    the values named here, not from what the module's patterns find."""
    def secret(value):
        return (hashlib.sha256(f"riskfold-demo-key|secret|{value}".encode()).hexdigest() * (len(value) // 64 + 1))[:len(value)]

    def mail(value):
        return "u" + hashlib.sha256(f"riskfold-demo-key|mail|{value}".encode()).hexdigest()[:16] + "@example.invalid"

    def iban(value):
        body = refill(value, permute_digits("iban", re.sub("[^0-9]", "", value)[2:]), 2)
        return f"{value[:2]}{98 - mod97((value[:2] + '00' + body[4:]).replace(' ', '')):02d}{body[4:]}"

    hexes, long_mail = "0123456789abcdef" * 8, "ann" + "-x" * 70 + "@mail.example.com"
    labels = "a@" + ".".join("abcdefghijk") + ".com"
    cases = [
        ("pay BE68 5390 0754 7034 EUR now", f"pay {iban('BE68 5390 0754 7034')} EUR now"),
        ("pay BE68539007547034 EUR now", f"pay {iban('BE68539007547034')} EUR now"),
        ("IBAN GB82 WEST 1234 5698 7654 32 BIC X", f"IBAN {iban('GB82 WEST 1234 5698 7654 32')} BIC X"),
        ("not BE69 5390 0754 7034 EUR", "not BE69 5390 0754 7034 EUR"),
        ('password="correct horse battery staple" x', f'password="{secret("correct horse battery staple")}" x'),
        ("token = 'abc\"defgh ijklmnop' y", f"token = '{secret('abc' + chr(34) + 'defgh ijklmnop')}' y"),
        ("password=hunter2hunter2, next", f"password={secret('hunter2hunter2')}, next"),
        ("API_KEY: abcdef0123456789\nend", f"API_KEY: {secret('abcdef0123456789')}\nend"),
        ("the secret: everything changes; token: someone", "the secret: everything changes; token: someone"),
        (f"sha {hexes} end", f"sha {(hashlib.sha256(f'riskfold-demo-key|hex|{hexes}'.encode()).hexdigest() * 3)[:128]} end"),
        (f"to {long_mail}.", f"to {mail(long_mail)}."),
        (f"to {labels}, or", f"to {mail(labels)}, or"),
        ('token = "no closing quote_here9 x\nnext', f'token = "no closing quote_here9 x\nnext'),
    ]
    rows = pii.pseudonymise(docs(spark, [t for t, _ in cases])).orderBy("doc_id").collect()
    for row, (text, want) in zip(rows, cases, strict=True):
        assert row.text == want, text
    assert mod97(iban("BE68539007547034")) == 1
