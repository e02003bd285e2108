import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(items, docs, k=10):
    held = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    held = [(i, c, c.total()) for i, c in held if c]
    n, total = len(held), sum(h[2] for h in held)
    df = Counter(t for _, c, _ in held for t in c)
    least = {}
    for i, t in items:
        if i is not None and t is not None:
            least[i] = min(t, least.get(i, t))
    out = []
    for item, text in least.items():
        asked, scores = terms(text), []
        for doc, c, size in held:
            m = 25 + 75 * size * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if score > 0:
                scores.append((-score, doc))
        out += [(item, r + 1, d, -s) for r, (s, d) in enumerate(sorted(scores)[:k])]
    return sorted(out)


def rows(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_given_tables(spark):
    folder = "/root/testdata/sf0.001"
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.item_id, r.text) for r in items.collect()], [(r.doc_id, r.text) for r in docs.collect()])
    assert rows(lexical.search(items, lexical.index(docs))) == want


@pytest.mark.parametrize("batch, width, block, sent", [(1 << 14, 4096, 512, 1 << 20), (8, 16, 3, 0), (1, 1, 1, 1 << 20)])
def test_hard_cases(spark, odd, batch, width, block, sent, monkeypatch):
    monkeypatch.setattr(lexical, "BATCH", batch)
    monkeypatch.setattr(lexical, "DOCUMENTS", block)
    monkeypatch.setattr(lexical, "BROADCAST", sent)
    odd = odd.unionByName(odd.limit(3).selectExpr("cast(null as long) doc_id", *[f"`{c}`" for c in odd.columns if c != "doc_id"]))
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    asked = [(0, "the Word word 123 ß É"), (1, None), (2, ""), (3, "nowhere-to-be-found"), (4, docs[0][1]), (4, "zzz"), (5, "1 2 3 don't"),
             (None, "the"), (6, "名前と数字123 😀😀"), (7, docs[5][1] * 30), (8, "same LINE same line"), (9, "é combining")]
    items = spark.createDataFrame([(i, t, "x", 1) for i, t in asked], "item_id long, text string, doc_id string, score int")
    assert rows(lexical.search(items, lexical.index(odd), width=width)) == brute(asked, docs)


def test_empty_sides(spark, documents):
    items = spark.createDataFrame([(1, "the")], "item_id long, text string")
    assert lexical.search(items, lexical.index(documents.limit(0))).count() == 0
    assert lexical.search(items.limit(0), lexical.index(documents)).count() == 0


def test_ties_and_fewer_rows(spark):
    docs = spark.createDataFrame([(i, "common rare") for i in range(30, 0, -1)] + [(50 + i, "other word") for i in range(100)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "rare"), (2, "other")], "item_id long, text string")
    got = rows(lexical.search(items, lexical.index(docs), k=40))
    assert [r[2] for r in got if r[0] == 1] == list(range(1, 31)) and [r[2] for r in got if r[0] == 2] == list(range(50, 90))


def test_bounds_hold_and_spare_work():
    rng = random.Random(1)
    words = [f"w{i}" for i in range(5000)]
    import pyarrow as pa
    docs = [Counter(rng.choices(words, k=rng.randint(5, 200))) for _ in range(400)]
    lengths = np.array([d.total() for d in docs])
    block = lexical.Block(np.arange(400), lengths, np.array([*map(len, docs)]), pa.array([t for d in docs for t in d]),
                          np.array([n for d in docs for n in d.values()], np.int64), 400, int(lengths.sum()), 4096)
    batch = lexical.Batch([{"id": 1, "terms": rng.sample(words, 20), "weights": [rng.randint(1, 9000) for _ in range(20)]}], 5, 4096)
    bounds = (block.sketch[:, batch.coordinates] @ batch.lookup).ravel()
    exact = np.zeros(400, np.int64)
    for d in range(400):
        for t, w in zip(*batch.items[0]):
            hit = [block.impacts[i] for i in range(block.starts[d], block.starts[d + 1]) if batch.terms.get(block.distinct[block.codes[i]], -1) == t]
            exact[d] += w * sum(hit)
    assert (bounds >= exact).all()
    scored = block.search(batch)
    assert scored < 400 and sorted(exact.tolist(), reverse=True)[:5] == batch.best[0][0].tolist()


def test_index_is_read_a_few_blocks_at_a_time(spark):
    """Pages and row groups hold a few blocks, however many a task writes."""
    import pyarrow.parquet as pq

    docs = spark.range(40 * lexical.DOCUMENTS).coalesce(1).selectExpr("id as doc_id", "array_join(transform(sequence(1, 100), i -> concat('w', pmod(hash(id, i), 100000))), ' ') as text")
    files = [pq.ParquetFile(f.removeprefix("file://")) for f in lexical.index(docs).inputFiles()]
    assert sum(f.metadata.num_rows for f in files) == 40
    groups = [f.metadata.row_group(i) for f in files for i in range(f.num_row_groups)]
    assert max(g.num_rows for g in groups) <= 10 and max(g.column(c).total_uncompressed_size for g in groups for c in range(g.num_columns)) < 8 << 20
