import datetime
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from vacantia.llm import langid, pii

KEY = "k"
HARD = ["x und.34@mail7.example.com y.", "4539148803436467 and 4539 1488 0343 6467, not 4539148803436468", "+1 (017) 555-7713 +1 (017) 555-7713",
        "233.254.104.120 999.1.1.1 1.2.3.4.5", "GB82 WEST 1234 5698 7654 32 DE89370400440532013000 DE88370400440532013000",
        "2024-02-29 31/12/1999 12/31/1999 2023-02-30", "123-45-6789 000-12-3456", 'token = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"', "", None,
        "no data 12", "(212) 555-1234 212-555-1234 +4915112345678", "x" * 100_000 + " a.b@c.de", "a.b@c.de"]


def luhn(number):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(re.sub(r"\D", "", number))))) % 10 == 0


def mod97(value):
    bare = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97


@pytest.fixture(scope="module")
def hidden(spark):
    table = spark.createDataFrame([(i, t, "s") for i, t in enumerate(HARD)], "doc_id long, text string, n_replaced string").withColumn("_found", F.lit(1))
    out = pii.pseudonymise(table, KEY)
    assert out.columns == ["doc_id", "text", "_found", "n_replaced"]
    return {r.doc_id: r for r in out.collect()}


def test_formats_stay_and_equal_values_stay_linked(hidden):
    card, spaced = re.findall(r"\b(\d{16}|\d{4} \d{4} \d{4} \d{4})\b", hidden[1].text)[:2]
    assert luhn(card) and card == spaced.replace(" ", "") != "4539148803436467" and hidden[1].text.endswith("not 4539148803436468")
    a, b = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", hidden[2].text)
    assert a == b != "+1 (017) 555-7713" and hidden[2].n_replaced == 2
    ip = re.match(r"(\d+)\.(\d+)\.(\d+)\.(\d+) 999\.1\.1\.1 1\.2\.3\.4\.5$", hidden[3].text)
    assert all(int(g) < 256 for g in ip.groups()) and "233.254.104.120" not in hidden[3].text and hidden[3].n_replaced == 1
    gb, de = re.match(r"(GB\d\d WEST \d{4} \d{4} \d{4} \d\d) (DE\d{20}) DE88370400440532013000$", hidden[4].text).groups()
    assert mod97(gb) == mod97(de) == 1 and hidden[4].n_replaced == 2
    dates = hidden[5].text.split()
    assert datetime.date.fromisoformat(dates[0]) and datetime.datetime.strptime(dates[1], "%d/%m/%Y") and datetime.datetime.strptime(dates[2], "%m/%d/%Y")
    assert dates[3] == "2023-02-30" and hidden[5].n_replaced == 3
    assert re.match(r"123-\d\d-\d{4} 000-12-3456$", hidden[6].text) and "45-6789" not in hidden[6].text
    assert re.match(r'token = "[0-9A-F]{40}"$', hidden[7].text) and "9233A8" not in hidden[7].text
    assert re.match(r"\(\d{3}\) \d{3}-\d{4} \d{3}-\d{3}-\d{4} \+\d{13}$", hidden[11].text) and "212" not in hidden[11].text[:5]
    address = hidden[13].text
    assert re.match(r"[a-z0-9]\.[a-z0-9]@c\.de$", address) and hidden[12].text == "x" * 100_000 + " " + address


def test_other_texts_stay(hidden):
    assert (hidden[8].text, hidden[9].text, hidden[10].text) == ("", None, "no data 12")
    assert hidden[8].n_replaced == hidden[9].n_replaced == hidden[10].n_replaced == 0


def test_permutations_are_one_to_one(spark):
    values = spark.range(0, 1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    for radix in (10, 16, 36):
        got = [r.x for r in values.select(pii.permute_digits(F.col("d"), radix, KEY, "t").alias("x")).collect()]
        assert len(set(got)) == 1000 and all(len(x) == 3 for x in got)
    pairs = spark.range(0, 99 * 50).select(pii.feistel(F.col("id") % 99, F.floor(F.col("id") / 99), F.lit(99).cast("bigint"), F.lit(50).cast("bigint"),
                                                       KEY, "t").alias("x"))
    got = {(r.x.a, r.x.b) for r in pairs.collect()}
    assert len(got) == 99 * 50 and max(a for a, _ in got) == 98 and max(b for _, b in got) == 49


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(docs, langid.fit(docs)).withColumn("held_out", langid.held_out("doc_id")).collect()
    assert {r.held_out for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 == 2} == {True}
    assert {r.held_out for r in out if zlib.crc32(str(r.doc_id).encode()) % 4 != 2} == {False}
    right = [r.lang == r.lang_pred for r in out if r.held_out]
    assert sum(right) >= 0.98 * len(right) and all(0 <= r.score <= 1 for r in out)


def test_language_of_hard_texts(documents, odd):
    model = langid.fit(documents)
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert len(got) == documents.count()
    for r in documents.collect():
        letters = any(map(str.isalpha, r.text or ""))
        assert (got[r.doc_id].lang_pred == "und") == (not letters)
        assert got[r.doc_id].lang_pred in ["und", *model.languages]
    nothing = langid.fit(documents.limit(0))
    assert nothing is None and {r.lang_pred for r in langid.identify(documents, nothing).collect()} == {"und"}
    single = langid.fit(documents.filter("lang = 'en'"))
    assert single.predict(__import__("numpy").zeros((1, langid.BINS))) == [("en", 1.0)]
    by_text = defaultdict(set)
    for r in got.values():
        by_text[r.text].add((r.lang_pred, r.score))
    assert all(len(v) == 1 for v in by_text.values())


def test_families_part_before_languages():
    import numpy as np

    rng = np.random.default_rng(0)
    words = {x: [bytes(rng.integers(97, 123, 5).astype(np.uint8)).decode() for _ in range(40)] for x in ("en", "de", "nl", "fr", "es", "ja")}
    texts = [(x, " ".join(rng.choice(w, 60))) for x, w in words.items() for _ in range(30)]
    rows = []
    for _, t in texts:
        v = langid.grams(t)
        at = np.flatnonzero(v)
        rows.append((at, v[at]))
    model = langid.Model([x for x, _ in texts], rows)
    assert model.families == ["germanic", "ja", "romance"] and len(model.pairs) == 4
    fresh = [(x, " ".join(rng.choice(w, 60))) for x, w in words.items() for _ in range(10)]
    assert [p for p, _ in model.predict(np.array([langid.grams(t) for _, t in fresh]))] == [x for x, _ in fresh]
