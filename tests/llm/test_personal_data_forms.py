import datetime
import re

import pytest
from test_language_pii import mod97

from vacantia.llm import pii

# one valid number of each country whose groups of four leave no rest, and others
NUMBERS = ["BE68 5390 0754 7034", "AT61 1904 3002 3457 3201", "ES91 2100 0418 4502 0005 1332", "SE45 5000 0000 0583 9825 7466",
           "CZ65 0800 0000 1920 0014 5399", "PL61 1090 1014 0000 0712 1981 2874", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947"]
PHONES = ["212 555 1234", "020 7946 0958", "0161 496 0000", "01632 960 001", "07700 900123", "06 12 34 56 78", "030 1234567"]
AFTER = ["", " BIC GKCCBEBB", " 2024-02-29", " 12", " AB12 x", "."]


def hidden(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r.text, r.n_replaced) for r in pii.pseudonymise(rows, "k").orderBy("doc_id").collect()]


@pytest.mark.parametrize("after", AFTER)
def test_account_numbers_end_where_their_country_says(spark, after):
    texts = [x + after for x in NUMBERS] + [x.replace(" ", "") + after for x in NUMBERS]
    for text, (got, n) in zip(texts, hidden(spark, texts)):
        size = len(text) - len(after)
        assert got[:size] != text[:size] and mod97(got[:size]) == 1 and re.sub(r"\d", "0", got) == re.sub(r"\d", "0", text)
        dated = after == " 2024-02-29"
        assert n == 1 + dated and (dated and got[size:] != after or got[size:] == after)


def test_a_number_that_fails_leaves_the_rest_to_be_searched(spark):
    (got, n), = hidden(spark, ["BE69 5390 0754 7034 2024-02-29"])
    assert got.startswith("BE69 5390 0754 7034 ") and not got.endswith("2024-02-29") and n == 1


@pytest.mark.parametrize("around", [("", ""), ("Tel ", " GKCC"), ("A ", " 12"), ("(", ").")])
def test_national_phone_numbers(spark, around):
    texts = [around[0] + x + around[1] for x in PHONES]
    for phone, text, (got, n) in zip(PHONES, texts, hidden(spark, texts)):
        assert n == 1 and phone not in got and re.sub(r"\d", "0", got) == re.sub(r"\d", "0", text) and got.endswith(around[1])


def test_days_and_months_of_one_digit(spark):
    texts = ["3/4/2024", "3.4.2024 BIC", "3-04-2024", "2024-4-3 12", "2024/4/3", "3/25/2024", "03/04/2024", "31/2/2024", "2024-2-30"]
    out = hidden(spark, texts)
    days = [datetime.datetime.strptime(got.split(" ")[0], form) for (got, _), form in zip(out, ["%d/%m/%Y", "%d.%m.%Y", "%d-%m-%Y", "%Y-%m-%d", "%Y/%m/%d"])]
    assert len(set(days)) == 1 and [n for _, n in out] == [1] * 7 + [0, 0] and [t for t, _ in out[7:]] == texts[7:]
    assert all(t.split(" ")[1:] == g.split(" ")[1:] for t, (g, _) in zip(texts, out))
    assert len(out[6][0]) == 10 and out[0][0] != "3/4/2024" and not re.search(r"(^|/)0", out[0][0])
