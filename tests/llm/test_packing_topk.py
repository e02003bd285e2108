import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from vacantia.llm import packing, topk


@pytest.mark.parametrize("group", [2, 256])
def test_pieces_hold_every_id_once(documents, odd, group):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = packing.tokenizer(path)
    want = defaultdict(list)
    for r in documents.collect():
        want[r.doc_id].append([*library.encode(r.text or "", add_special_tokens=False).ids, 1])
    got = packing.pack(odd, path, group=group).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for p in got:
        ids = np.frombuffer(p.ids, np.uint32)
        assert len(ids) == p.length > 0
        sequences[p.sequence_id].append((p.offset, p.length))
        docs[p.doc_id].append((p.start, p.doc_tokens, ids.tolist()))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, parts in docs.items():
        assert sum((p[2] for p in sorted(parts)), []) == want[doc_id][0] and {p[1] for p in parts} == {len(want[doc_id][0])}
    assert set(docs) == set(want)
    assert packing.pack(documents.limit(0), path).count() == 0


def test_little_padding():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 513, 3000).tolist()
    bins = packing.windows(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(3000))
    loads = [sum(sizes[i] for i in b) for b in bins]
    assert max(loads) <= 2048 and sum(sizes) >= 0.99 * 2048 * len(bins)
    assert packing.windows([], 10) == [] and packing.windows([10, 10, 1], 10) and packing.difference([5], 3) == [[0]]


def brute(rows, queries, k):
    out = []
    for q in queries:
        scores = sorted((-int(np.dot(rows[q].astype(object), v)), i) for i, v in rows.items() if i != q and len(v) == len(rows[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("scale", [3, 10 ** 9])
def test_search_is_exact(spark, scale):
    rng = np.random.default_rng(2)
    rows = {i: rng.integers(-scale, scale + 1, 5) for i in range(700)}
    for i in range(50, 300):
        rows[i] = rows[50]  # one very common vector
    rows[699] = np.array([1, 2])
    data = [(i, v.tolist(), 1) for i, v in rows.items()] + [(9999, None, 1), (None, [1, 2, 3, 4, 5], 1)]
    table = spark.createDataFrame(data, "vec_id long, vector array<long>, rank int").repartition(7)
    for shard, tile in ((16, 4), (4096, 1024)):
        got = topk.search(table.filter("vec_id % 10 = 0"), table, k=10, shard=shard, tile=tile)
        assert sorted(map(tuple, got.collect())) == brute(rows, [i for i in rows if i % 10 == 0], 10)
    assert topk.search(table.limit(0), table).count() == topk.search(table, table.limit(0)).count() == 0
    few = table.filter("vec_id in (0, 1, 2)")
    assert topk.search(few, few).count() == 6


def test_quantised(spark):
    rows = [(0, [0.5, -0.0001, 1.0]), (1, None), (2, [1.0, None]), (3, [float("nan")]), (4, [float("inf")]), (5, [])]
    table = spark.createDataFrame(rows, "i int, v array<float>")
    got = {r.i: r.x for r in table.select("i", topk.quantised("v", 1024).alias("x")).collect()}
    assert got == {0: [512, math.floor(1024 * float(np.float32(-0.0001))), 1024], 1: None, 2: None, 3: None, 4: None, 5: []}
