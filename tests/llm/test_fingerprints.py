import hashlib
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vacantia.llm import fingerprints as fp

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def brute_pieces(text):
    text = text or ""
    for end in fp.ENDS:
        text = text.replace(end, end + "\n")
    return [x for p in text.split("\n") for x in ([p[i:i + 256] for i in range(0, len(p), 256)] or [""])]


def brute_lanes(pieces):
    lanes = [0] * 128
    for p in pieces:
        digest = hashlib.sha256(p.encode()).hexdigest()
        for lane in range(128):
            bit = int(digest[8 * (lane // 32):8 * (lane // 32) + 8], 16) >> (lane % 32) & 1
            lanes[lane] += 2 * bit - 1
    return [x % 65536 for x in lanes]


def brute_likeness(a, b):
    if a == b:
        return 1.0
    a, b = ([x - 65536 if x >= 32768 else x for x in v] for v in (a, b))
    norms = sum(x * x + y * y for x, y in zip(a, b))
    return min(1.0, max(0.0, 2 * sum(x * y for x, y in zip(a, b)) / norms))


def check(df, docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0]))
    got = {r.doc_id: r for r in df.select("*", fp.likeness(F.col("lanes"), F.col("edited_lanes")).alias("near"),
                                          fp.spelled(F.col("lanes")).alias("hex")).collect()}
    assert len(got) == len(docs)
    for n, (key, text) in enumerate(docs):
        following, gone = docs[(n + 1) % len(docs)][1], len(text) // 4
        edited = text[:len(text) - gone] + following[:gone]
        r = got[key]
        assert (r.text, r.edited_text, r.next_text) == (text, edited, following)
        lanes, others = brute_lanes(brute_pieces(text)), brute_lanes(brute_pieces(edited))
        assert r.lanes == lanes and r.edited_lanes == others and r.next_lanes == brute_lanes(brute_pieces(following))
        assert r.near == brute_likeness(lanes, others) and r.hex == "".join(f"{x:04x}" for x in lanes)


@pytest.mark.parametrize("ids", ["numbers", "texts", "null first"])
def test_edits_against_brute_force(spark, ids):
    texts = [None, "", "a", "One. Two! Three? Four。five\nsix\n", "x" * 1000, "é" * 255 + ". " + "😀" * 300, "\n\n", "same", "same"] * 4
    keys = [i * 37 % 101 for i in range(len(texts))]
    if ids == "texts":
        keys = [f"k{k}é" for k in keys]
    if ids == "null first":
        keys[5] = None
    kind = "string" if ids == "texts" else "long"
    docs = spark.createDataFrame(list(zip(keys, texts, texts)), f"doc_id {kind}, text string, next_text string").repartition(7)
    check(fp.with_edits(docs), list(zip(keys, texts)))


def test_few_rows(spark):
    schema = "doc_id long, text string"
    assert fp.with_edits(spark.createDataFrame([], schema)).count() == 0
    check(fp.with_edits(spark.createDataFrame([(7, "abcdefgh")], schema)), [(7, "abcdefgh")])
    repeated = fp.with_edits(spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "c")], schema)).collect()
    assert sorted((r.doc_id, r.next_text) for r in repeated) == [(1, "a b"), (1, "c"), (2, "a b")]


def test_next_keeps_every_row_once(spark):
    docs = spark.range(20_000).select((F.col("id") * 7919 % 100_003).alias("doc_id"), F.col("id").cast("string").alias("text"),
                                      F.lit("g").alias("guest"), F.lit("r").alias("range"))
    out = fp.with_next(docs, ["text"], ranges=64)
    assert out.columns == [*docs.columns, "next_text"]
    got = sorted((r.doc_id, r.text, r.next_text) for r in out.collect())
    assert len(got) == 20_000 and all(a[2] == b[1] for a, b in zip(got, got[1:] + got[:1]))


def test_sums(spark):
    row = spark.createDataFrame([("one\ntwo\nthree", "three\none\ntwo", "two", "one\nthree", None)], "a string, b string, c string, d string, n string")
    of = lambda c: fp.fingerprint(fp.paragraphs(F.col(c)))
    r = row.select(of("a") == of("b"), fp.added(of("c"), of("d")) == of("a"), fp.removed(of("a"), of("c")) == of("d"),
                   fp.likeness(of("a"), of("a")), fp.likeness(of("a"), of("d")), fp.likeness(of("a"), of("n")), of("a") == of("d")).first()
    assert list(r[:4]) == [True, True, True, 1.0] and abs(r[4] - 0.8) < 0.2 and r[5] < 0.3 and r[6] is False


def test_long_array_wraps(spark):
    r = spark.range(1).select(fp.fingerprint(F.array_repeat(F.lit("p"), 70_000)).alias("x")).first()
    one = brute_lanes(["p"])
    assert r.x == [(70_000 * (x if x < 32768 else x - 65536)) % 65536 for x in one]


def test_likeness_tells_edits_from_others(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("n_chars > 1000")
    out = fp.with_edits(docs).select(fp.likeness(F.col("lanes"), F.col("edited_lanes")).alias("e"), fp.likeness(F.col("lanes"), F.col("next_lanes")).alias("n"))
    r = out.filter("n < 1").agg(F.avg("e"), F.avg("n"), F.avg((F.col("e") > F.col("n")).cast("int"))).first()
    print(r)
    assert r[0] > 0.6 and r[1] < 0.2 and r[2] > 0.95
