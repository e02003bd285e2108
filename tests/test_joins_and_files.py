"""Joins against brute force, resume, sinks and multi-batch streams."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from vacantia.operators import joins as A, summaries as M
from vacantia.sources import sinks
from vacantia.streaming import streams as Z


def test_title_matches_equal_brute_force(spark):
    rng = random.Random(3)
    vocab = ["data", "engineer", "a", "b", "lead", "岗位", "xdata", "engineering", "of"]
    titles = list({" ".join(rng.choice(vocab) for _ in range(rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(60)})
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(25)) + rng.choice(["", "\ndata engineer", "ab lead of"])) for i in range(80)]
    want = {(t, i) for t in titles for i, x in texts if t in x}
    got = A.title_matches(spark.createDataFrame([(t,) for t in titles], "title string"), spark.createDataFrame(texts, "card int, text string"), "title", "card", "text")
    assert {(r.title, r.card) for r in got.collect()} == want and want


def test_ids_match_on_word_boundaries(spark):
    recs = spark.createDataFrame([("12",), ("a-1",), ("9",)], "id string")
    cards = spark.createDataFrame([(1, "/jobs/12?x"), (2, "/jobs/123"), (3, "id a-1 end"), (4, "xa-1"), (5, "/p/9/9")], "card int, blob string")
    got = A.id_matches(recs, cards, "id", "card", F.col("blob"))
    assert {(r.id, r.card) for r in got.collect()} == {("12", 1), ("a-1", 3), ("9", 5)}


def test_second_resume_changes_nothing(spark):
    good = "岗位职责 " + "x" * 200
    jobs = spark.createDataFrame([("r", i, good if i < 4 else None) for i in range(10)], "run string, id int, full_jd string")
    out = spark.createDataFrame([("r", 4, good, "SUCCESS"), ("r", 5, None, "FAILED"), ("r", 6, None, "SKIPPED"), ("r", 0, "worse", "SUCCESS")], "run string, id int, new_jd string, outcome string")
    first = A.resume(jobs, out, "run", "id")
    s = A.resume_stats(first, "run").first()
    assert (s.preexisting, s.requested, s.new_success, s.failed, s.skipped, s.still_missing) == (4, 6, 1, 1, 4, 5)
    again = A.resume(first.select("run", "id", "full_jd"), out.limit(0), "run", "id")
    assert A.resume_targets(first).count() == 5 and sorted(r.full_jd or "" for r in again.collect()) == sorted(r.full_jd or "" for r in first.collect())


def test_detail_buckets_add_up(spark):
    recs = spark.createDataFrame([("r", i, ["API", "BROWSER_X", None, None][i % 4]) for i in range(20)], "run string, id int, src string")
    errs = spark.createDataFrame([("r", 2, "BOT_CHALLENGE"), ("r", 2, "JD_NOT_FOUND"), ("r", 3, "JD_NOT_FOUND"), ("r", 6, "OTHER")], "run string, id int, code string")
    a = M.detail_accounting(recs, errs, "run", "id", "src").first()
    assert a.total == a.http_resolved + a.browser_resolved + a.blocked + a.failed + a.pending == 20
    assert (a.blocked, a.failed, a.pending) == (1, 1, 8)


def test_merge_never_lets_a_teaser_replace_a_description(spark):
    long = "responsibilities " + "x " * 200
    lst = spark.createDataFrame([(1, long, ""), (2, "teaser", "d"), (3, None, None)], "id int, description string, department string")
    det = spark.createDataFrame([(1, "short", "D"), (2, long, "E"), (9, "x", "y")], "id int, description string, department string")
    got = {r.id: (r.description, r.department) for r in A.merge_detail(lst, det, "id", ["description", "department"]).collect()}
    assert got == {1: (long, "D"), 2: (long, "d"), 3: (None, None)}


def test_files_are_written_in_their_shape(spark, tmp_path):
    lines = spark.createDataFrame([("r", j, i, f"{j}-{i}") for j in range(30) for i in range(20)], "run_id string, job_no bigint, line_no int, line string").repartition(7)
    sinks.write_report(lines, "run_id", str(tmp_path / "report"))
    parts = sorted((tmp_path / "report" / "run_id=r").glob("part-*"))
    assert "".join(p.read_text() for p in parts).split() == [f"{j}-{i}" for j in range(30) for i in range(20)]
    none = F.lit(None).cast("string")
    jobs = spark.createDataFrame([("1", "=T", ["a", "b"])], "job_id string, job_title string, locations array<string>").withColumns(
        {n: none for n in ("company", "department", "education", "recruitment_type", "publish_date", "detail_url", "apply_url", "jd_enrichment_status")}).withColumns(
        {"responsibilities": F.col("locations"), "requirements": F.array().cast("array<string>")})
    sinks.write_jobs_csv(jobs, str(tmp_path / "csv"))
    parts = [p.read_bytes() for p in (tmp_path / "csv").glob("part-*")]
    assert len(parts) == 1 and parts[0].startswith(b"\xef\xbb\xbfid,title")  # no file without a row
    assert "1,'=T".encode() in parts[0] and "a ⏎ b".encode() in parts[0]
    sinks.write_jobs_json(jobs, str(tmp_path / "json"))
    back = spark.read.schema(jobs.schema).json(str(tmp_path / "json")).collect()
    assert [(r.job_id, r.job_title, r.locations) for r in back] == [("1", "=T", ["a", "b"])]
    errors = spark.createDataFrame([("r", "HTTP_403", "x")], "run_id string, code string, reason string")
    sinks.write_rows_json(errors, str(tmp_path / "errors"))
    assert spark.read.json(str(tmp_path / "errors")).count() == 1
    sinks.write_layout(errors.selectExpr("*", "'ok' as outcome", "'Co' as company_dir", "'s' as stamp"), str(tmp_path / "runs"))
    assert [p.name for p in (tmp_path / "runs" / "outcome=ok" / "company_dir=Co" / "stamp=s").glob("*.parquet")]


def test_checkpoint_replaces_one_run_and_checks_its_format(spark, tmp_path):
    path = str(tmp_path / "cp")
    rows = lambda *r: spark.createDataFrame(list(r), "run_id string, job_id bigint, state string")
    sinks.write_checkpoint(rows(("a", 1, "PENDING"), ("b", 2, "PENDING")), path)
    sinks.write_checkpoint(rows(("a", 1, "SUCCESS")), path)
    read = sinks.read_checkpoint(spark, path, "job_id bigint, state string")
    assert {(r.run_id, r.state) for r in read.collect()} == {("a", "SUCCESS"), ("b", "PENDING")}
    # a write that fails, or has not ended, leaves the old state to readers
    bad = rows(("a", 1, "BROKEN"), ("a", 2, "BROKEN")).withColumn("state", F.when(F.col("job_id") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("state")))
    with pytest.raises(Exception, match="lost"):
        sinks.write_checkpoint(bad, path)
    orphan = Path(path) / "data" / "0" / "run_id=a"
    orphan.mkdir(parents=True)
    (orphan / "x.json").write_text('{"job_id":1,"state":"HALF"}')
    state = lambda: {(r.run_id, r.job_id, r.state) for r in sinks.read_checkpoint(spark, path, "job_id bigint, state string").collect()}
    assert state() == {("a", 1, "SUCCESS"), ("b", 2, "PENDING")}
    sinks.write_checkpoint(rows(("a", 3, "NEW"), ("c", 4, "PENDING")), path)  # a run is replaced whole
    whole = {("a", 3, "NEW"), ("b", 2, "PENDING"), ("c", 4, "PENDING")}
    assert state() == whole
    sinks.merge_checkpoint(spark, path, "job_id bigint, state string")
    assert state() == whole and len(sinks._commits(spark, path)) == 1
    assert sinks.read_checkpoint(spark, str(tmp_path / "none"), "job_id bigint, state string").count() == 0
    folder = Path(path) / "data" / sinks._commits(spark, path)[0][2] / "run_id=d"
    folder.mkdir()
    (folder / "x.json").write_text('{"job_id":1,"state":"x","format":"other"}')
    with pytest.raises(Exception, match="CHECKPOINT_UNSUPPORTED"):
        sinks.read_checkpoint(spark, path, "job_id bigint, state string").collect()


@pytest.fixture()
def batches(spark, tmp_path):
    """Three files that arrive one per micro-batch."""
    rows = [("r", p, k, p * 10 + k) for p in range(6) for k in ([1, 2, 3] if p < 4 else [2, 3])]
    for n, pages in enumerate(((0, 1), (2, 3), (4, 5))):
        part = [r for r in rows if r[1] in pages]
        spark.createDataFrame(part, "run string, page int, k int, seq int").coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    schema = "run string, page int, k int, seq int"
    return rows, lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))


def test_progress_remembers_ids_across_batches(spark, tmp_path, batches):
    rows, stream = batches
    folder = str(tmp_path / "out")
    Z.stream_progress(stream(), "run", "page", "k", folder)
    got = spark.read.parquet(f"{folder}/pages")
    assert sum(r.new_ids for r in got.collect()) == 3 and got.filter("no_progress").count() == 5
    Z.stream_progress(stream(), "run", "page", "k", folder)  # nothing new: a restart adds nothing
    assert spark.read.parquet(f"{folder}/pages").count() == 6
    extra = spark.createDataFrame([("r", 7, 1, 71), ("r", 7, 8, 72), ("r", 8, 8, 81), (None, 1, None, 1), (None, 2, None, 2)], "run string, page int, k int, seq int")
    extra.coalesce(1).write.parquet(str(tmp_path / "in" / "b3"))
    Z.stream_progress(stream(), "run", "page", "k", folder)  # a restart knows the ids of earlier batches
    got = {(r.run, r.page): (r.records, r.new_ids) for r in spark.read.parquet(f"{folder}/pages/batch=3").collect()}
    assert got == {("r", 7): (2, 1), ("r", 8): (1, 0), (None, 1): (1, 1), (None, 2): (1, 0)}


def quiet(times, gap, least, most):
    """Brute force over the sorted activity of one run."""
    out, i = [], 0
    while i < len(times):
        j = i + 1
        while j < len(times) and times[j] - times[j - 1] < gap and times[j] - times[i] < most:
            j += 1
        span, cut = times[j - 1] - times[i], times[j - 1] + gap > times[i] + most
        out.append((times[i], j - i, most if cut else span, "MAX_OBSERVATION" if cut else "BELOW_MINIMUM" if span < least else "QUIET"))
        i = j
    return out


@pytest.mark.parametrize("streaming", [False, True])
def test_windows_are_cut_at_the_maximum(spark, tmp_path, streaming):
    """A burst of 40 s is four windows of at most 12 s; late and unordered activity of a batch finds its window."""
    rng = random.Random(4)
    runs = {"burst": [i * 0.5 for i in range(80)], "calm": [0.0, 1.0, 5.0, 5.5, 9.0], "same": [3.0] * 5, None: [1.0, 2.0]}
    runs |= {f"r{n}": sorted(round(rng.uniform(0, 90), 2) for _ in range(60)) for n in range(5)}
    rows = [(k, t) for k, ts in runs.items() for t in ts]
    rows.sort(key=lambda r: r[1] + rng.uniform(-4, 4))
    rows += [("late clock", 1000.0)]
    schema = "run string, at double"
    for n in range(4):
        part = rows[n * len(rows) // 4:(n + 1) * len(rows) // 4]
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    path, moment = str(tmp_path / "in" / "*"), F.timestamp_millis((F.col("at") * 1000).cast("long") + 86_400_000).alias("ts")
    if streaming:
        df = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path).select("run", moment)
        found = Z.drain(Z.quiet_periods(df, "run", "ts", "20 seconds", 1.5, 2.5, 12), str(tmp_path / "out"))
    else:
        found = Z.quiet_periods(spark.read.schema(schema).parquet(path).select("run", moment), "run", "ts", "20 seconds", 1.5, 2.5, 12)
    got = sorted((r.run or "", r.first_at.timestamp(), r.activities, r.observed_seconds, r.ended_by) for r in found.collect() if r.run != "late clock")
    want = sorted((k or "", *w) for k, ts in runs.items() for w in quiet(ts, 1.5, 2.5, 12))
    assert [(g[0], g[2], g[4]) for g in got] == [(w[0], w[2], w[4]) for w in want]
    assert all(abs(g[3] - w[3]) < 1e-3 and abs(g[1] - got[0][1] - w[1] + want[0][1]) < 1e-3 for g, w in zip(got, want))
    assert sum(g[0] == "burst" for g in got) == 4


def test_snapshots_carry_states_across_batches(spark, tmp_path, batches):
    rows, stream = batches
    folder = str(tmp_path / "snap")
    Z.snapshot_states(stream().withColumn("state", F.concat(F.lit("s"), "page")), "run", "k", "state", "seq", folder, merge_every=2)
    got = {r.k: (r.state, r.updates) for r in Z.latest_snapshot(spark, folder).collect()}
    assert got == {1: ("s3", 4), 2: ("s5", 6), 3: ("s5", 6)}
    # ids 2 and 3 only: a batch writes the keys that it holds
    assert {r.k for r in spark.read.parquet(f"{folder}/changes/batch=2").collect()} == {2, 3}
    assert [p.name for p in (tmp_path / "snap" / "merged").iterdir()] == ["batch=1"]
    assert [tuple(r) for r in Z.earned_snapshots(Z.latest_snapshot(spark, folder), "run", 4).collect()] == [("r", 4)]
    extra = spark.createDataFrame([("r", 9, 2, 99), ("q", 1, 1, 100)], "run string, page int, k int, seq int")
    extra.coalesce(1).write.parquet(str(tmp_path / "in" / "b3"))
    Z.snapshot_states(stream().withColumn("state", F.concat(F.lit("s"), "page")), "run", "k", "state", "seq", folder, merge_every=2)  # a restart goes on
    got = {(r.run, r.k): (r.state, r.updates) for r in Z.latest_snapshot(spark, folder).collect()}
    assert got == {("r", 1): ("s3", 4), ("r", 2): ("s9", 7), ("r", 3): ("s5", 6), ("q", 1): ("s1", 1)}
    assert spark.read.parquet(f"{folder}/changes/batch=3").count() == 2
