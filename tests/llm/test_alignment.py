import bisect
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from vacantia.llm import alignment
from vacantia.llm.tokens import BYTE_LETTERS

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LETTERS = {v: k for k, v in BYTE_LETTERS.items()}


class Brute:
    """Whole texts through the libraries, ends by decoded bytes alone, every token pair compared."""

    def __init__(self):
        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)

    def tokens(self, text):
        if not text:
            return [], []
        found = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(LETTERS[c] for c in t)) for i, t in zip(found.ids, found.tokens)]
        ids = self.b.encode(text)
        b = [(i, bytes([i - 3]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode()) for i in ids]
        whole = (" " + text).encode()
        return (a, b) if whole == b"".join(x for _, x in a) == b"".join(x for _, x in b) else ([], [])

    def linked(self, text):
        a, b = self.tokens(text)
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, raw in side:
                out.append((i, at, at + len(raw)))
                at += len(raw)
            spans.append(out)
        starts = [s for _, s, _ in spans[1]]
        links = []
        for i, s, e in spans[0]:
            j = max(0, bisect.bisect_right(starts, s) - 1)
            while j < len(starts) and starts[j] < e:
                if spans[1][j][2] > s:
                    links.append((i, spans[1][j][0]))
                j += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        held = [defaultdict(list), defaultdict(list)]
        for side, tokens in zip(held, spans):
            for i, _, e in tokens:
                side[bisect.bisect_left(cuts, e)].append(str(i))
        return len(a), len(b), links, ";".join(f"{','.join(held[0][g])}|{','.join(held[1][g])}" for g in range(len(cuts))), len(cuts)


def brute(texts):
    known = Brute()
    found = [known.linked(t) for t in texts]
    count = Counter(p for f in found for p in set(f[2]))
    highest = Counter()
    for (a, _), n in count.items():
        highest[a] = max(highest[a], n)
    return [(n_a, n_b, cuts, len(links), sum(count[p] == highest[p[0]] for p in links), sum(count[p] for p in links), spelled)
            for n_a, n_b, links, spelled, cuts in found]


def rows(df):
    return sorted((r.doc_id, (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups)) for r in df.collect())


@pytest.mark.parametrize("block", [alignment.BLOCK, 5000])
def test_against_whole_texts(spark, odd, block, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", block)
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    want = sorted(zip([d[0] for d in docs], brute([d[1] for d in docs])))
    assert rows(alignment.align(odd, A, B)) == want
    assert alignment.align(odd.limit(0), A, B).count() == 0


def test_odd_texts(spark):
    rng = random.Random(3)
    parts = [" ", "  ", "\n", " \n", "\t ", "a", "the", "été", "名", "前と", "😀", "👩‍👩‍👧", " ", "\xa0", "ﬁ", "\x1c", "\r", "{\r", "<s>", "<|endoftext|>",
             "<0x41>", "\x00", "1999", "don't", "x" * 40, "ة", "́", "𝒳", "�", "  ", "."]
    texts = ["".join(rng.choices(parts, k=rng.randint(1, 12))) for _ in range(3000)]
    texts += [None, "", " ", "  ", "\n", "▁", "a ▁b", "word ", "word  ", " word", "\x00", "y " * 5000, "é" * 5000]
    got = rows(alignment.align(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), A, B))
    for (i, row), want in zip(got, brute(texts)):
        assert row == want, repr(texts[i])
    assert dict(got)[texts.index("▁")] == (0, 0, 0, 0, 0, 0, "")


def test_null_ids_repeat(spark):
    docs = spark.createDataFrame([(None, "two words"), (None, "two words"), (1, None)], "doc_id long, text string")
    out = alignment.align(docs, A, B).collect()
    assert sorted((r.doc_id is None, r.n_a) for r in out) == [(False, 0), (True, 2), (True, 2)]


def test_query_digest(spark):
    from vacantia.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in QUERIES["op11_alignment"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    for doc, want in zip(docs, brute([d.text for d in docs])):
        r = got.pop(doc.doc_id)
        digest = hashlib.sha256(want[6].encode()).hexdigest() if want[6] else ""
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == (*want[:6], digest)
    assert not got
