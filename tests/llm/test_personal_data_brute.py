"""Pseudonyms against a second implementation in plain Python, one value at a time."""

import datetime
import hashlib
import random

import regex

from vacantia.llm import pii

KEY = "k1"
# back references as this library spells them
KINDS = {k: p.replace(r"\k<mark>", "(?P=mark)").replace(r"\k<four>", "(?P=four)").replace(r"\k<six>", "(?P=six)") for k, p in pii.KINDS.items()}
DIGITS = "0123456789abcdefghijklmnopqrstuvwxyz"


def feistel(a, b, mod_a, mod_b, label):
    def mixed(step, other, modulus):
        return int(hashlib.sha256(f"{KEY}|{label}|{step}|{other}|{modulus}".encode()).hexdigest()[:15], 16) % modulus

    for step in range(8):
        if step % 2 == 0:
            a = (a + mixed(step, b, mod_a)) % mod_a
        else:
            b = (b + mixed(step, a, mod_b)) % mod_b
    return a, b


def spelled(n, radix, width):
    out = ""
    for _ in range(width):
        out, n = DIGITS[n % radix] + out, n // radix
    return out


def permuted(digits, radix, label):
    out = ""
    for i in range(0, len(digits), 18):
        part = digits[i:i + 18]
        left = len(part) // 2
        right = len(part) - left
        a, b = feistel(int(part[:left] or "0", radix), int(part[left:], radix), radix ** left, radix ** right, f"{label}{radix}")
        out += spelled(a, radix, left) + spelled(b, radix, right)
    return out


def refilled(mask, digits, slots):
    rest = iter(digits)
    return "".join(next(rest) if c in slots else c for c in mask)


def only(text, slots="0123456789"):
    return "".join(c for c in text if c in slots)


def luhn(digits, follows):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2 == (0 if follows else 1):
            d = 2 * d - (9 if d > 4 else 0)
        total += d
    return total


def mod97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def day_of(value):
    n = regex.split(r"[/.\-]", value)
    order = "ymd" if len(n[0]) == 4 else "mdy" if int(n[1]) > 12 else "dmy"
    part = dict(zip(order, map(int, n)))
    try:
        return order, n, regex.search(r"[/.\-]", value)[0], (datetime.date(part["y"], part["m"], part["d"]) - datetime.date(1900, 1, 1)).days
    except ValueError:
        return None


def pseudonym(value):
    kind = next(k for k, p in KINDS.items() if regex.fullmatch(p, value))
    if kind == "email":
        local, host = value.rsplit("@", 1)
        local = local.lower()
        return refilled(local, permuted(only(local, DIGITS), 36, "email"), DIGITS) + "@" + host
    if kind == "iban":
        bare = value.replace(" ", "")
        if mod97(bare[4:] + bare[:4]) != 1:
            return None
        new = refilled(bare[4:], permuted(only(bare[4:]), 10, "iban"), "0123456789")
        return refilled(value, bare[:2] + f"{98 - mod97(new + bare[:2] + '00'):02}" + new, only(value, DIGITS.upper()))
    if kind == "secret":
        new = permuted(value.lower(), 16, "secret")
        return new.upper() if value == value.upper() else new
    if kind == "date":
        found = day_of(value)
        if not found or not 0 <= found[3] < 65536:
            return None
        order, n, mark, day = found
        a, b = feistel(day // 256, day % 256, 256, 256, "date")
        new = datetime.date(1900, 1, 1) + datetime.timedelta(days=a * 256 + b)
        number = {"y": new.year, "m": new.month, "d": new.day}
        return mark.join(f"{number[o]:04}" if o == "y" else str(number[o]) if len(x) == 1 else f"{number[o]:02}" for o, x in zip(order, n))
    if kind == "social":
        area, group, serial = value.split("-")
        if area in ("000", "666") or area[0] == "9" or group == "00" or serial == "0000":
            return None
        a, b = feistel(int(group) - 1, int(serial) - 1, 99, 9999, "social")
        return f"{area}-{a + 1:02}-{b + 1:04}"
    if kind == "phone":
        code = (regex.match(r"\+[0-9]{1,3}(?=[ .(\-])", value) or [""])[0]
        rest = value[len(code):]
        return code + refilled(rest, permuted(only(rest), 10, "phone"), "0123456789")
    if kind == "card":
        digits = only(value)
        if digits[0] not in "23456" or luhn(digits, False) % 10:
            return None
        body = digits[0] + permuted(digits[1:-1], 10, "card")
        return refilled(value, body + str(-luhn(body, True) % 10), "0123456789")
    octets = [int(x) for x in value.split(".")]
    if max(octets) > 255:
        return None
    a, b = feistel(octets[0] * 256 + octets[1], octets[2] * 256 + octets[3], 65536, 65536, "address")
    return ".".join(str(x) for x in (a // 256, a % 256, b // 256, b % 256))


def brute(text):
    if text is None or not regex.search("[0-9@]", text):
        return text, 0
    done = [0]

    def put(match):
        new = pseudonym(match[0])
        done[0] += new is not None
        return match[0] if new is None else new

    return regex.sub("|".join(KINDS.values()), put, text), done[0]


def test_texts_against_the_second_implementation(spark, documents):
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = ["a.b-c+1@x-y.example.org", "Ab@EXAMPLE.com", "BE68 5390 0754 7034", "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "2024-02-29", "2023-02-29",
              "3/4/2024", "31.12.1899", "12-25-2020", "1.1.2079", "123-45-6789", "000-12-3456", "666-12-3456", "+49 30 1234 5678", "(212) 555-1234", "030 1234 5678",
              "4111 1111 1111 1111", "4111111111111112", "378282246310005", "10.0.0.255", "256.1.1.1", "f" * 40, "A1" * 20, "12345678901234567890123"]
    values += [f"+{digits(12)}" for _ in range(20)] + [f"4{digits(15)}" for _ in range(60)] + [".".join(str(rng.randrange(300)) for _ in range(4)) for _ in range(40)]
    values += [f"{rng.randrange(1890, 2090)}-{rng.randrange(1, 14):02}-{rng.randrange(1, 33):02}" for _ in range(60)]
    texts = [None, "", " and ".join(values), *[f"x {v}, y" for v in values], "no data"] + [r.text for r in documents.collect()]
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").limit(400)
    texts += [r.text for r in given.collect()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_replaced) for r in pii.pseudonymise(df.withColumn("n_replaced", df.doc_id), KEY).collect()}
    for i, text in enumerate(texts):
        assert got[i] == brute(text), text
    assert sum(n for _, n in got.values()) > 300
    assert pii.pseudonymise(df.limit(0), KEY).count() == 0
