import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from test_near_duplicates import brute as brute_near
from test_simhash_quality import brute_fingerprint, roots

import corpus_pipeline as pipeline
from vacantia.llm import langid, line_dedup, packing, simhash


def brute_lines(texts, least):
    """Kept texts with counts of lines and of dropped lines."""
    lines = [(t or "").split("\n") for t in texts]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for ls in lines for k in {key(x) for x in ls} if k)
    out = []
    for ls in lines:
        kept = [x for x in ls if not key(x) or seen[key(x)] < least]
        out.append(("\n".join(kept), len(ls), len(ls) - len(kept)))
    return out


def test_line_dedup(spark, documents, odd):
    rows = documents.collect()
    for table, least in ((documents, 10), (odd, 3), (odd, 1)):
        got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(table, least).collect()}
        assert got == dict(zip([r.doc_id for r in rows], brute_lines([r.text for r in rows], least)))
    assert line_dedup.dedup_lines(documents.limit(0)).count() == 0
    many = spark.createDataFrame([(None, "x\ny"), (None, "x\ny"), (1, None), (1, " X \nz"), (1, "a\n\nB")], "doc_id long, text string")
    assert Counter(tuple(r) for r in line_dedup.dedup_lines(many, 3).collect()) == Counter(
        [(None, "y", 2, 1), (None, "y", 2, 1), (1, "", 1, 0), (1, "z", 2, 1), (1, "a\n\nB", 3, 0)])


def test_line_dedup_beyond_the_broadcast(documents, monkeypatch):
    want = Counter(map(tuple, line_dedup.dedup_lines(documents, 3).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", -1)
    assert Counter(map(tuple, line_dedup.dedup_lines(documents, 3).collect())) == want


def test_one_of_each_group_stays(spark, documents):
    rows = documents.collect()
    want = roots([r.doc_id for r in rows], [brute_fingerprint(r.text, 5) for r in rows], 3)
    got = simhash.representatives(documents.withColumn("_key", F.lit(1)))
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values())) and "_key" in got.columns
    twice = documents.filter("doc_id < 5").union(documents.filter("doc_id < 5")).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    kept = simhash.representatives(twice).collect()
    assert len(kept) == len({r.text for r in kept}) and sum(r.doc_id is None for r in kept) == 3


def test_stages_one_by_one(spark, documents, tmp_path):
    """Every stage against its brute-force version on what the stage before kept."""
    folder = str(tmp_path / "documents.parquet")
    documents.write.parquet(folder)
    docs = spark.read.parquet(folder)
    steps = [docs]
    for _, stage in pipeline.STAGES:
        steps.append(pipeline.stored(stage(spark, steps[-1], str(tmp_path))))
    rows = [s.collect() for s in steps]
    assert all(s.columns == pipeline.COLUMNS for s in steps[:-1])
    model = langid.fit(docs)
    for r in rows[0]:
        x = langid.grams(r.text)
        good = x is not None and model.predict(x[None].astype(np.float32))[0][1] >= 0.5
        assert good == any(k.doc_id == r.doc_id for k in rows[1])
    want = brute_lines([r.text for r in rows[1]], 10)
    assert {r.doc_id: r.text for r in rows[2]} == {r.doc_id: w[0] for r, w in zip(rows[1], want)}
    assert sorted(r.doc_id for r in rows[3]) == brute_near([(r.doc_id, r.text) for r in rows[2]])
    texts = {r.doc_id: r.text for r in rows[3]}
    assert {r.doc_id for r in rows[4]} == set(texts)
    for r in rows[4]:
        assert not set(re.findall(r"[\w.]+@[\w.]+\.com", texts[r.doc_id])) & set(re.findall(r"[\w.]+@[\w.]+\.com", r.text))
        assert len(r.text) == len(texts[r.doc_id]) or re.search(r"\d+\.\d+\.\d+\.\d+", r.text)
    library = packing.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for p in rows[5]:
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(texts)
    for r in rows[4]:
        ids = np.array([*library.encode(r.text, add_special_tokens=False).ids, 1], np.uint32)
        at = 0
        for p in sorted(pieces[r.doc_id], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at:at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    again = pipeline.run(spark, str(tmp_path))
    assert Counter((r.doc_id, r.start) for r in again.collect())[rows[4][0].doc_id, 0] == 1
