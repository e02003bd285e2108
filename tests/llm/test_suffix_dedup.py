import hashlib
from collections import Counter

import numpy as np
import pytest

from vacantia.llm import suffix_dedup
from vacantia.llm.queries import QUERIES


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i:i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, np.int64)
        for i in range(len(r) - length + 1):
            if seen[r[i:i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:len(r)] > 0
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def result(table, length, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest())
            for r in suffix_dedup.dedup(table, length, **options).collect()}


def test_repeated_starts():
    rng = np.random.default_rng(1)
    for size, letters, length in ((300, 2, 9), (2000, 3, 12), (3000, 20, 40), (50, 1, 10)):
        text = rng.integers(1, letters + 1, size).astype(np.uint8)
        text[size // 2:size // 2 + size // 5] = text[:size // 5]
        raw = text.tobytes()
        seen = Counter(raw[i:i + length] for i in range(size - length + 1))
        want = [i <= size - length and seen[raw[i:i + length]] > 1 for i in range(size)]
        assert suffix_dedup.repeated_starts(text, length).tolist() == want


def test_anchors_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [rng.integers(97, 100, n).astype(np.uint8).tobytes() for n in (10, 399, 400, 401, 3000)] + [b"", b"a" * 1000]
    for part in (1 << 20, 700):
        monkeypatch.setattr(suffix_dedup, "PART", part)
        text, anchor, first, last, gram = suffix_dedup.anchors(texts, 400)
        starts = Counter((t, p) for t, f, z in zip(text.tolist(), first.tolist(), last.tolist()) for p in range(f, z + 1))
        assert starts == Counter((i, p) for i, t in enumerate(texts) for p in range(len(t) - 399))
        assert all(f <= z <= a <= f + 368 for a, f, z in zip(anchor.tolist(), first.tolist(), last.tolist()))
        same = {}
        for t, a, g in zip(text.tolist(), anchor.tolist(), gram.tolist()):
            assert same.setdefault(g, texts[t][a:a + 32]) == texts[t][a:a + 32]


@pytest.mark.parametrize("options", [{}, {"group": 3, "chunk": 2000}, {"group": 1}])
def test_given_documents(documents, odd, options):
    rows = documents.collect()
    assert result(odd, 400, **options) == dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 400)))


def test_a_passage_in_many_places(spark):
    """A passage in different surroundings, shorter and longer than the threshold, and periodic texts."""
    rng = np.random.default_rng(3)
    letters = "abcdefgh éß"
    word = lambda n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    long, short = word(90), word(40)
    texts = [word(60) + (long if i % 3 else short) + word(50) for i in range(60)] + [long[5:] + word(30) + long[:70]]
    texts += ["ab" * 100, "x" * 70, "x" * 49, None, "", long, long, word(300) + long]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    want = dict(enumerate(brute(texts, 50)))
    for options in ({}, {"group": 2}, {"group": 8, "chunk": 500}):
        assert result(table, 50, **options) == want
    assert result(table.limit(0), 50) == {}


def test_halves_of_a_segment_do_not_meet_each_other(spark):
    """A segment with partners in both halves of a crowded anchor, all in one transform: what stands once stays."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join("abcdefgh"[i] for i in rng.integers(0, 8, n))
    pool = word(50_000)
    at = int((suffix_dedup._gram_hashes(np.frombuffer(pool.encode(), np.uint8)) >> np.uint64(32)).argmin())
    anchor, left, right = pool[at:at + 32], word(12), word(12)
    texts = [word(30) + left + anchor + right + word(30), word(30) + left + anchor + word(42), word(42) + anchor + right + word(30),
             word(36) + left[-6:] + anchor + right + word(30)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = dict(enumerate(brute(texts, 50)))
    assert [want[i][1] for i in range(4)] == [50, 0, 0, 50]
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        assert result(table, 50, group=3) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_the_query_shows_what_is_left(spark, tmp_path):
    """A planted passage is gone from the text, clean texts are whole, cut characters are marked and counted as bytes."""
    rng = np.random.default_rng(4)
    word = lambda: "".join("abcdefghij"[i] for i in rng.integers(0, 10, 7))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, short = prose(60), prose(40)
    texts = [f"{prose(30)}{i} {passage} {i}{prose(20)}" for i in range(5)] + [f"{prose(30)} {short}" for _ in range(2)] + [prose(90), None, passage + "é", passage + "è"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r for r in QUERIES["op3_suffix_dedup"](spark, str(tmp_path)).collect()}
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for _, r in sorted(out.items())] == brute(texts, 400)
    for i, text in enumerate(texts[:8]):
        assert out[i].text == (text if i >= 5 else text.replace(f" {passage} ", ""))
    assert [out[i].text for i in (8, 9, 10)] == ["", "\ufffd", "\ufffd"]
