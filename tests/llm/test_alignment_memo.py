import public_tokenizers

from vacantia.llm import alignment


def test_the_memo_is_bounded_by_bytes(monkeypatch):
    """Few long chunks fill it as many short ones do."""
    monkeypatch.setattr(alignment, "MEMO", 4000)
    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    aligner.learn([" word", " " + "long" * 2000])
    known = dict(aligner.memo)
    aligner.forget()
    assert len(known) == 2 and not aligner.memo and aligner.held == 0
    aligner.learn([" word"])
    aligner.forget()
    assert aligner.memo == {" word": known[" word"]}
