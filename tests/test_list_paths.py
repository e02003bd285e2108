"""Job lists at any path."""

import pytest

from vacantia.plans import inputs as I, load


@pytest.mark.parametrize("outer, inner", [("data", "rows"), ("payload", "items")])
def test_jobs_of_any_list_path(spark, monkeypatch, outer, inner):
    folder = "/root/testdata/sf0.001"
    want = sorted(map(tuple, load()["captured_jobs"](spark, folder).collect()))
    old = "'result', named_struct('total', n_chars, 'list',"
    assert old in I.PAYLOAD_SQL
    monkeypatch.setattr(I, "PAYLOAD_SQL", I.PAYLOAD_SQL.replace(old, f"'{outer}', named_struct('total', n_chars, '{inner}',"))
    assert want and sorted(map(tuple, load()["captured_jobs"](spark, folder).collect())) == want
