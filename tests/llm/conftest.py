import sys
from pathlib import Path

import pytest

for folder in Path(__file__).resolve().parents[1:3]:
    sys.path.insert(0, str(folder))

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from vacantia.session import local_session

    return local_session(8, shuffle_partitions=8)


@pytest.fixture(scope="session")
def documents(spark):
    """The given documents with hard cases: nulls, blanks, repeats, ties, odd characters, a long text."""
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long_text = " ".join(r[1] for r in rows if r[1])[:150_000]
    extra = [None, "", " \t\n\x0b", "\n\n", "a", "ß É İ", "word", "Word  word", rows[0][1], rows[0][1], rows[1][1] + " and one more.",
             long_text, "x" * 3000, "one two three " * 400, "emoji 😀😀   nbsp here \x1c sep", "<|endoftext|> in a text", "1,2;3 don't we'll",
             "é combining ẛ̣", "名前と数字123", "same line\nsame line\nother"]
    rows += [(100_000 + i, t, None if i % 2 else "en", None, None) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def odd(documents):
    """The same documents with extra columns, named like the operators' own."""
    names = ["_row", "_key", "n_lines", "fp", "kept", "start", "component_id", "lang_pred"]
    return documents.selectExpr("*", *[f"source as `{n}`" for n in names])
