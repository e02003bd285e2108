import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from vacantia.llm import components, quality, simhash

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, size):
    words = WORDS.findall((text or "").encode().lower())
    grams = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(ids, fps, most):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(lambda: 1 << 64)
    for i in range(len(ids)):
        least[find(i)] = min(least[find(i)], ids[i])
    return {ids[i]: least[find(i)] for i in range(len(ids))}


def test_clusters_are_those_of_all_pairs(documents, odd):
    rows = documents.collect()
    fps = [brute_fingerprint(r.text, 3) for r in rows]
    want = roots([r.doc_id for r in rows], fps, 3)
    for table in (documents, odd):
        got = simhash.clusters(table).collect()
        assert {r.doc_id: r.fingerprint for r in got} == {r.doc_id: f"{f:016x}" for r, f in zip(rows, fps)}
        assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert simhash.clusters(documents.limit(0)).count() == 0


def test_links_with_crowded_buckets(spark):
    """Buckets over the limit are cut further and lose no link."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(150):
            x = int(b)
            for k in rng.integers(0, 64, rng.integers(1, 7)):
                x ^= 1 << int(k)
            fps.add(x)
    fps = sorted(fps)
    want = roots(fps, fps, 3)
    table = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for bucket in (20_000, 8):
        links = simhash.links(table, 3, bucket).collect()
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            a, b = find(a % (1 << 64)), find(b % (1 << 64))
            root[max(a, b)] = min(a, b)
        group = {f: find(f) for f in fps}
        assert group == want


def test_components(spark):
    rng = np.random.default_rng(5)
    chain = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3)]
    pairs = chain + [tuple(map(int, p)) for p in rng.integers(2000, 2400, (150, 2))]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        if a is not None and a != b:
            near[a].add(b)
            near[b].add(a)
    want = {}
    for n in sorted(near):
        todo = [n]
        while todo:
            x = todo.pop()
            if x not in want:
                want[x] = n
                todo += near[x]
    assert got == want


def brute_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n, r = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, r, n < 20 or 100 * r > 30 * n


def test_measures_and_verdict(documents, odd):
    for table in (documents, odd):
        got = quality.judge(table).collect()
        assert len(got) == documents.count()
        texts = {r.doc_id: r.text for r in documents.collect()}
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_measures(texts[r.doc_id]), texts[r.doc_id]
            assert 0 <= r.quality <= 1 and r.kept == (not r.base_failed and r.quality >= 0.5)
    assert quality.judge(documents.limit(0)).count() == 0


def test_verdict_follows_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    got = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), keep=["doc_id"])
    labels = spark.read.parquet(f"{folder}/labels.parquet").withColumnRenamed("quality", "label")
    table = Counter({(r.label, r.kept): r["count"] for r in got.join(labels, "doc_id").groupBy("label", "kept").count().collect()})
    assert table[1, True] >= 0.97 * (table[1, True] + table[1, False])
    assert table[0, False] >= 0.9 * (table[0, True] + table[0, False])
