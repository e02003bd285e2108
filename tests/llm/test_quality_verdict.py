import math

from vacantia.llm import quality


def brute_verdict(rows):
    """Expectation-maximisation over every document by itself, in plain Python."""
    votes = []
    for r in rows:
        facts = {m: r[m] for m in quality.MEASURES}
        votes.append([-1 if eval(bad, {}, facts) else 1 if eval(good, {}, facts) else 0 for good, bad in quality.RULES.values()])
    good = [0.05 if -1 in v else 0.95 for v in votes]
    n = len(quality.RULES)
    for _ in range(50):
        share = min(0.98, max(0.02, sum(good) / len(good)))
        plus, minus = [0.0] * n, [0.0] * n
        for k in range(n):
            held = {(c, v): start for c, starts in ((1, (6.0, 0.5, 1.0)), (0, (3.0, 3.0, 2.0))) for v, start in zip((1, -1, 0), starts)}
            for v, g in zip(votes, good):
                held[1, v[k]] += g
                held[0, v[k]] += 1 - g
            total = {c: sum(held[c, v] for v in (1, -1, 0)) for c in (0, 1)}
            weight = {v: math.log(held[1, v] / total[1]) - math.log(held[0, v] / total[0]) for v in (1, -1)}
            plus[k], minus[k] = max(weight[1], 0.0), min(weight[-1], 0.0)
        prior = math.log(share / (1 - share))
        odds = [prior + sum(p if x == 1 else m if x == -1 else 0.0 for x, p, m in zip(v, plus, minus)) for v in votes]
        good = [1 / (1 + math.exp(-min(50.0, max(-50.0, o)))) for o in odds]
    failed = [r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words for r in rows]
    return [(1 / (1 + math.exp(-o)), not f and o >= 0) for o, f in zip(odds, failed)]


def test_verdict_against_every_document(spark, odd):
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    for table in (odd, more):
        rows = quality.judge(table).collect()
        want = brute_verdict(rows)
        assert all(abs(r.quality - q) < 1e-9 for r, (q, _) in zip(rows, want))
        assert [r.kept for r in rows] == [k for _, k in want]
        assert {r.kept for r in rows} == {True, False}
