"""Personal data replaced by format-preserving pseudonyms: keyed Feistel permutations inside each value's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, without

ROUNDS = 8

# fixed values: the formats that are looked for, in the order in which they are tried
EMAIL = (r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+\-]{0,63}@[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?"
         r"(?:\.[A-Za-z0-9](?:[A-Za-z0-9\-]{0,61}[A-Za-z0-9])?){1,8}")
# characters of an account number by country; spaced ones stand in groups of four
LENGTHS = {15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
           22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
           26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
           31: "MT SC", 32: "LC", 33: "RU"}


def _account(length: int, countries: str) -> str:
    groups, rest = divmod(length - 4, 4)
    spaced = f"(?: [A-Z0-9]{{4}}){{{groups}}}" + (f" [A-Z0-9]{{{rest}}}" if rest else "")
    return f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:[A-Z0-9]{{{length - 4}}}|{spaced})"


# countries without a known length, last, may take any number of groups
IBAN = (r"\b(?=[A-Z]{2}[0-9]{2})(?:" + "|".join(_account(n, c) for n, c in LENGTHS.items()) + r"|(?!" + "|".join(" ".join(LENGTHS.values()).split())
        + r")[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?))\b")
DATE = (r"(?<![0-9])(?:[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}"
        r"|[0-9]{1,2}(?<mark>[/.\-])[0-9]{1,2}\k<mark>[0-9]{4})(?![0-9])")
SOCIAL = r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])"
PHONE = (r"(?<![0-9+])(?:\+[0-9]{1,3}[ .\-]?\([0-9]{1,4}\)(?:[ .\-]?[0-9]{2,4}){2,3}|\+[0-9]{1,3}(?:[ .\-][0-9]{2,4}){3,5}|\+[0-9]{8,15}"
         r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}|[0-9]{3}[ .\-][0-9]{3}[ .\-][0-9]{4}"
         r"|0[0-9]{2} [0-9]{4} [0-9]{4}|0[0-9]{3} [0-9]{3} [0-9]{4}|0[0-9]{4} [0-9]{3} [0-9]{3}|0[1-9](?: [0-9]{2}){4}|0[0-9]{2,4} [0-9]{5,8})(?![0-9])")
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?<four>[ \-])[0-9]{4}\k<four>[0-9]{4}\k<four>[0-9]{4}|[0-9]{4}(?<six>[ \-])[0-9]{6}\k<six>[0-9]{5})(?![0-9])"
ADDRESS = r"(?<![0-9.])[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])"
SECRET = r"(?<![0-9A-Za-z])[0-9A-Fa-f]{32,128}(?![0-9A-Za-z])"
KINDS = {"email": EMAIL, "iban": IBAN, "secret": SECRET, "date": DATE, "social": SOCIAL, "phone": PHONE, "card": CARD, "address": ADDRESS}
ANY = "|".join(KINDS.values())
EPOCH, DAYS = "1900-01-01", 1 << 16


def _mixed(key: str, label: str, step: Column, other: Column, modulus: Column) -> Column:
    """The round function: a keyed digest of the other half, below the modulus."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(label), step.cast("string"), other.cast("string"), modulus.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), modulus)


def feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: str, label: str) -> Column:
    """A permutation of the pairs (a below mod_a, b below mod_b): halves are shifted in turn by a digest of the other."""

    def turn(pair, step):
        even = F.pmod(pair.a + _mixed(key, label, step, pair.b, mod_a), mod_a)
        odd = F.pmod(pair.b + _mixed(key, label, step, pair.a, mod_b), mod_b)
        first = step % 2 == 0
        return F.struct(F.when(first, even).otherwise(pair.a).alias("a"), F.when(first, pair.b).otherwise(odd).alias("b"))

    start = F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(radix: int, n: Column) -> Column:
    return F.pow(F.lit(float(radix)), n).cast("bigint")  # at most 2^48: exact


def permute_digits(digits: Column, radix: int, key: str, label: str) -> Column:
    """Another string of as many lower-case digits of the radix (10, 16 or 36), part by part of at most 18 digits."""

    def one(start):
        part = F.substring(digits, start, F.lit(18))
        size = F.length(part)
        left = F.floor(size / 2).cast("int")
        whole = F.struct(part.alias("p"), left.alias("l"), (size - left).alias("r"))
        return F.transform(F.array(whole), lambda w: halves(w))[0]

    def halves(w):
        def number(s):
            return F.coalesce(F.conv(F.when(F.length(s) > 0, s).otherwise("0"), radix, 10).cast("bigint"), F.lit(0))

        pair = feistel(number(F.substring(w.p, F.lit(1), w.l)), number(F.substring(w.p, w.l + 1, w.r)), _power(radix, w.l), _power(radix, w.r), key,
                       f"{label}{radix}")
        return F.transform(F.array(pair), lambda x: F.concat(padded(x.a, w.l), padded(x.b, w.r)))[0]

    def padded(x, n):
        return F.lpad(F.lower(F.conv(x.cast("string"), 10, radix)), n, "0") if radix != 10 else F.lpad(x.cast("string"), n, "0")

    starts = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)), F.lit(18))
    return F.array_join(F.transform(starts, lambda s: F.when(F.length(digits) == 0, "").otherwise(one(s))), "")


def _characters(text: Column) -> Column:
    return F.split(text, "")


def refill(mask: Column, digits: Column, slot: str) -> Column:
    """The mask with its characters of the class ``slot`` taken, in order, from ``digits``."""
    def put(acc, c):
        hit = c.rlike(slot)
        return F.struct(F.concat(acc.out, F.when(hit, F.substring(digits, acc.n + 1, F.lit(1))).otherwise(c)).alias("out"),
                        (acc.n + F.when(hit, 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(_characters(mask), start, put, lambda acc: acc.out)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn_sum(digits: Column, check_follows: bool) -> Column:
    """Digit sum of the card check; with ``check_follows`` the check digit is still to come."""
    def add(acc, i):
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        double = (i % 2 == (0 if check_follows else 1))
        return acc + F.when(double, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def card(value: Column, key: str) -> Column:
    """First digit and check stay valid; the digits between are permuted."""
    digits = _digits(value)
    body = F.concat(F.substring(digits, 1, 1), permute_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), 10, key, "card"))
    full = F.transform(F.array(body), lambda b: F.concat(b, F.pmod(10 - F.pmod(luhn_sum(b, True), F.lit(10)), F.lit(10)).cast("string")))[0]
    return refill(value, full, "[0-9]")


def _mod97(text: Column) -> Column:
    """Remainder by 97 of a string whose letters count as 10 to 35."""
    def add(acc, c):
        n = F.conv(c, 36, 10).cast("int")
        return F.pmod(acc * F.when(n > 9, 100).otherwise(10) + n, F.lit(97))

    return F.aggregate(_characters(text), F.lit(0), add)


def iban_valid(value: Column) -> Column:
    bare = F.regexp_replace(value, " ", "")
    return _mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1


def iban(value: Column, key: str) -> Column:
    """Country and letters stay, digits of the account are permuted, check digits are computed anew."""
    bare = F.regexp_replace(value, " ", "")
    account = F.substring(bare, F.lit(5), F.length(bare))
    new = refill(account, permute_digits(_digits(account), 10, key, "iban"), "[0-9]")
    country = F.substring(bare, 1, 2)
    full = F.transform(F.array(new), lambda n: F.concat(
        country, F.lpad((98 - _mod97(F.concat(n, country, F.lit("00")))).cast("string"), 2, "0"), n))[0]
    return refill(value, full, "[A-Z0-9]")


def phone(value: Column, key: str) -> Column:
    """The country code stays where it is set apart, all other digits are permuted."""
    code = F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(\-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    return F.concat(code, refill(rest, permute_digits(_digits(rest), 10, key, "phone"), "[0-9]"))


def _octet(value: Column, i: int) -> Column:
    return F.split(value, r"\.")[i].cast("int")


def address(value: Column, key: str) -> Column:
    """An IPv4 address to another one."""
    size = F.lit(1 << 16).cast("bigint")
    pair = feistel(_octet(value, 0) * 256 + _octet(value, 1), _octet(value, 2) * 256 + _octet(value, 3), size, size, key, "address")
    return F.transform(F.array(pair), lambda p: F.concat_ws(".", *[x.cast("string") for x in (
        F.floor(p.a / 256), p.a % 256, F.floor(p.b / 256), p.b % 256)]))[0]


def social_valid(value: Column) -> Column:
    return ~value.rlike("^(000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")


def social(value: Column, key: str) -> Column:
    """Area stays; group (1 to 99) and serial (1 to 9999) are permuted."""
    pair = feistel(F.substring(value, 5, 2).cast("int") - 1, F.substring(value, 8, 4).cast("int") - 1, F.lit(99).cast("bigint"),
                   F.lit(9999).cast("bigint"), key, "social")
    return F.transform(F.array(pair), lambda p: F.concat(F.substring(value, 1, 4), F.lpad((p.a + 1).cast("string"), 2, "0"), F.lit("-"),
                                                         F.lpad((p.b + 1).cast("string"), 4, "0")))[0]


def _day(value: Column) -> Column:
    """Days since 1900 of a written date, null if there is no such day; day before month where both are possible."""
    n = F.split(value, r"[/.\-]")
    first = F.length(n[0]) == 4
    monthly = ~first & (n[1].cast("int") > 12)
    year = F.when(first, n[0]).otherwise(n[2])
    month = F.when(first | ~monthly, n[1]).otherwise(n[0])
    day = F.when(first, n[2]).when(monthly, n[1]).otherwise(n[0])
    return F.datediff(F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd"), F.to_date(F.lit(EPOCH)))


def date(value: Column, key: str) -> Column:
    """A day of 1900 to 2079 to another one, written in the same order with the same separators; a part of one digit is not padded."""
    n = F.split(value, r"[/.\-]")
    yearly, monthly = F.length(n[0]) == 4, n[1].cast("int") > 12
    mark = F.regexp_extract(value, r"[/.\-]", 0)
    day, side = _day(value), F.lit(256).cast("bigint")
    pair = feistel(F.floor(day / 256), day % 256, side, side, key, "date")
    new = F.transform(F.array(pair), lambda p: F.date_add(F.lit(EPOCH).cast("date"), (p.a * 256 + p.b).cast("int")))

    def written(d, *order):
        def number(part, i):
            return F.date_format(d, part) if part == "yyyy" else F.when(F.length(n[i]) == 1, F.date_format(d, part[0])).otherwise(F.date_format(d, part))

        return F.concat_ws("", *[x for i, part in enumerate(order) for x in (mark, number(part, i))][1:])

    return F.transform(new, lambda d: F.when(yearly, written(d, "yyyy", "MM", "dd")).when(
        monthly, written(d, "MM", "dd", "yyyy")).otherwise(written(d, "dd", "MM", "yyyy")))[0]


def email(value: Column, key: str) -> Column:
    """Letters and digits before the sign are permuted, lower-cased, so that one address has one pseudonym."""
    local = F.lower(F.substring_index(value, "@", 1))
    bare = F.regexp_replace(local, "[^a-z0-9]", "")
    return F.concat(refill(local, permute_digits(bare, 36, key, "email"), "[a-z0-9]"), F.lit("@"), F.substring_index(value, "@", -1))


def secret(value: Column, key: str) -> Column:
    """Long hexadecimal keys, in the case in which they stand."""
    new = permute_digits(F.lower(value), 16, key, "secret")
    return F.when(value == F.upper(value), F.upper(new)).otherwise(new)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a matched value, or null where its check fails."""
    whole = {kind: value.rlike(f"^(?:{pattern})$") for kind, pattern in KINDS.items()}
    octets = F.greatest(*[_octet(value, i) for i in range(4)]) <= 255
    day = _day(value)
    return (F.when(whole["email"], email(value, key))
            .when(whole["iban"], F.when(iban_valid(value), iban(value, key)))
            .when(whole["secret"], secret(value, key))
            .when(whole["date"], F.when((day >= 0) & (day < DAYS), date(value, key)))
            .when(whole["social"], F.when(social_valid(value), social(value, key)))
            .when(whole["phone"], phone(value, key))
            .when(whole["card"], F.when(value.rlike("^[2-6]") & (luhn_sum(_digits(value), False) % 10 == 0), card(value, key)))
            .when(whole["address"], F.when(octets, address(value, key))))


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """Personal data in whole texts replaced by pseudonyms of the same format; ``n_replaced`` is added.

    E-mail addresses, account numbers (mod-97 check), hexadecimal secrets, dates that exist, social numbers, phone numbers,
    card numbers (issuer's first digit, digit check) and network addresses are looked for; a value that fails its check stays.  A value
    has the same pseudonym wherever it stands and under one key no two values of a format share one.  A null text
    stays null, a text without any digit and without @ stays as it is, repeated rows stay alike, an empty table stays
    empty, a column named ``n_replaced`` gives way, other columns stay.  Row by row, without a shuffle."""
    docs = without(docs, "n_replaced")
    found, new, pieces = fresh(docs, "_found", "_new", "_pieces")
    text = F.col(text_col)
    some = text.rlike("[0-9@]") & text.rlike(ANY)
    none = F.array().cast("array<string>")
    marked = docs.withColumn(found, F.when(some, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none))
    marked = marked.withColumn(new, F.transform(found, lambda v: pseudonym(v, key)))
    # the parts between the matches, one more than these
    marked = marked.withColumn(pieces, F.when(F.size(found) > 0, F.split(text, ANY, -1)).otherwise(none))
    value = F.zip_with(new, found, lambda n, v: F.coalesce(n, v))
    rebuilt = F.array_join(F.zip_with(pieces, value, lambda p, v: F.concat(p, F.coalesce(v, F.lit("")))), "")
    columns = [F.when(F.size(found) > 0, rebuilt).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns, F.size(F.filter(new, lambda n: n.isNotNull())).cast("bigint").alias("n_replaced"))
