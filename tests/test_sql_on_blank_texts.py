"""Queries against their SQL on texts without a word or without a first line, which the small tables lack."""

import duckdb
import pytest
from oracle_check import compare

from vacantia.plans import load

TEXTS = ["", " ", "\n", "\n\n", "\t", "\xa0", "　", "\nabc\ndef", " \nabc", "[]", "[]\nabc", "abc\n\ndef", "\x01"]
QUERIES = ["deep_picks", "deep_pick_nested", "connections", "detail_pages", "list_scores", "list_evidence", "response_shapes", "sampled_shapes"]


@pytest.fixture(scope="module")
def blank(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("blank")
    rows = [(4 * i + j, text, lang, "web", len(text)) for i, text in enumerate(TEXTS) for j, lang in enumerate(("en", "fr", "de", "es"))]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    return str(folder), con


@pytest.mark.parametrize("name", QUERIES)
def test_blank_texts_equal_their_sql(spark, blank, name):
    folder, con = blank
    assert compare(spark, con, load()[name], folder) is None
