import random
from collections import defaultdict

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from vacantia.llm import jaccard, simhash


def grams(text, size=5):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def similar(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """Smallest id of each group of pairs at 0.8 or more."""
    sets, root = [grams(t) for _, t in rows], list(range(len(rows)))
    owners = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or [None]:
            owners[g].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in {j for g in s or [None] for j in owners[g]}:
            if similar(s, sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(k, least.get(find(i), k))
    return sorted(least.values())


def edited(text, n, rng):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), n):
        words[i] = f"w{rng.random()}"
    return " ".join(words)


def test_pairs_from_four_fifths_on_are_one(spark, documents):
    """Planted copies with a few words changed: most are more than three bits apart."""
    rng = random.Random(1)
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    base = [t for _, t in rows if t and 60 < len(t.split(" ")) < 2000][:60]
    rows += [(200_000 + i, edited(t, max(1, len(t.split(" ")) * (1 + i % 4) // 100), rng)) for i, t in enumerate(base)]
    crowd = " ".join(f"word{i}" for i in range(400))
    rows += [(300_000 + i, edited(crowd, 4, rng)) for i in range(80)]
    want = brute(rows)
    table = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], documents.schema).repartition(4)
    got = sorted(r.doc_id for r in pipeline.near_duplicates(spark, table, "").collect())
    assert got == want
    assert len(simhash.representatives(table, shingle=5, most=3).collect()) > len(want)
    small = jaccard.representatives(table.withColumn("_key", F.lit(1)), chunk=2000)
    assert sorted(r.doc_id for r in small.collect()) == want and "_key" in small.columns


def test_repeated_rows_and_empty_texts(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (None, "a b"), (None, "c"), (None, "c"), (5, "A  B")]
    got = jaccard.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got if r.doc_id != 1) == [(0, "c"), (4, "a b")] and sum(r.doc_id == 1 for r in got) == 1
    assert jaccard.representatives(spark.createDataFrame([], "doc_id long, text string")).count() == 0
