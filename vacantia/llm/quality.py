"""Quality by weak supervision: rules vote or abstain, their accuracies are estimated, the posterior decides."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import BLANKS, slices, stored, without

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words", "n_letters", "n_upper", "n_shouts", "n_bars"]
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# votes of the rules: (name, good when, bad when); a rule abstains where neither holds
RULES = {
    "length": ("n_words >= 50", "n_words < 5"),
    "word_length": ("word_chars >= 3 * n_words and word_chars <= 10 * n_words", "word_chars < 2 * n_words or word_chars > 15 * n_words"),
    "symbols": ("50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    "letters": ("100 * n_letters >= 85 * word_chars", "100 * n_letters < 65 * word_chars"),
    "capitals": ("5 * n_upper <= n_letters", "2 * n_upper > n_letters"),
    "shouts": ("100 * n_shouts <= n_words", "10 * n_shouts > n_words"),
    "tables": ("50 * n_bars <= n_words", "8 * n_bars > n_words"),
    "repeats": ("20 * n_repeat_words <= n_words", "100 * n_repeat_words > 30 * n_words"),
    "lines": ("10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
}


def repeated(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each word (a code; ``doc`` ascending) whether a window over it stands twice or more in its document."""
    n = len(codes) - WINDOW + 1
    covered = np.zeros(len(codes) + 1, np.int64)
    if n < 2:
        return covered[:-1].astype(bool)
    with np.errstate(over="ignore"):
        mixed = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        h = np.zeros(n, np.uint64)
        for j in range(WINDOW):
            h = h * np.uint64(0xD6E8FEB86659FD93) + mixed[j:j + n]
        h += doc[:n].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1:])
    at = at[np.argsort(h[at], kind="stable")]
    same = h[at[1:]] == h[at[:-1]]
    a, b = at[:-1][same], at[1:][same]
    equal = doc[a] == doc[b]
    for j in range(WINDOW):  # equal hashes are compared word by word
        equal &= codes[a + j] == codes[b + j]
    hits = np.unique(np.concatenate([a[equal], b[equal]]))
    covered[hits] += 1
    covered[hits + WINDOW] -= 1
    return np.cumsum(covered[:-1]) > 0


def _measures(texts: list[str]) -> list[list[int]]:
    """One list per measure for a few texts."""
    ids, codes, lengths, rows = {}, [], [], []
    for text in texts:
        words = text.encode().split()
        codes.extend([ids.setdefault(w, len(ids)) for w in words])
        lengths.append(len(words))
        lines = text.split("\n")
        full = [x for x in lines if x.strip(BLANKS)]
        bare = len(text) - sum(map(text.count, BLANKS))
        if text.isascii():
            raw = np.frombuffer(text.encode(), np.uint8)
            upper = int(((raw >= 65) & (raw <= 90)).sum())
            letters = upper + int(((raw >= 97) & (raw <= 122)).sum())
        else:
            letters, upper = sum(map(str.isalpha, text)), sum(map(str.isupper, text))
        rows.append([len(words), bare, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), len(full), 0, letters, upper, text.count("!!"), text.count("|")])
    doc = np.repeat(np.arange(len(texts)), lengths)
    hit = np.bincount(doc[repeated(np.array(codes, np.int64), doc)], minlength=len(texts))
    for row, n in zip(rows, hit.tolist()):
        row[5] = n
    return [list(c) for c in zip(*rows)]


def _measured(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column(0).to_pylist()]
        columns = [[] for _ in MEASURES]
        for start, end in slices(texts):
            for column, values in zip(columns, _measures(texts[start:end])):
                column.extend(values)
        rest = [batch.column(i) for i in range(1, batch.num_columns)]
        yield pa.RecordBatch.from_arrays([*rest, *[pa.array(c, pa.int64()) for c in columns]],
                                         [*batch.schema.names[1:], *MEASURES])


def measure(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with the measures of each whole text; null counts as empty."""
    kept = without(docs, *MEASURES)
    names = [c for c in kept.columns if keep is None or c in keep]
    whole = kept.select(F.col(text_col), *[F.col(f"`{c}`") for c in names])
    schema = ", ".join([f"`{c}` {kept.schema[c].dataType.simpleString()}" for c in names] + [f"{m} long" for m in MEASURES])
    return whole.mapInArrow(_measured, schema)


def votes() -> dict[str, Column]:
    """1 for good, -1 for bad, 0 for no opinion."""
    return {name: F.when(F.expr(bad), -1).when(F.expr(good), 1).otherwise(0) for name, (good, bad) in RULES.items()}


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """Expectation-maximisation over vote patterns and their counts, two classes, rules independent within a class.

    Returns the log odds of a good document before any vote and, per rule, the log odds that its good and its bad
    vote add.  A rule's accuracy is estimated apart for either class, since bad votes are rare; a vote can lose all
    weight but never speak for the other side, so that the rules' own meaning names the classes."""
    if not patterns:
        return 0.0, [(0.0, 0.0)] * len(RULES)
    v = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], np.float64)
    cast = np.stack([v == 1, v == -1, v == 0])  # vote, pattern, rule
    good = np.where((v == -1).any(1), 0.05, 0.95)
    for _ in range(rounds):
        share = np.clip((n @ good) / n.sum(), 0.02, 0.98)
        in_good = np.einsum("vpr,p->vr", cast, n * good) + np.array([[6.0], [0.5], [1.0]])
        in_bad = np.einsum("vpr,p->vr", cast, n * (1 - good)) + np.array([[3.0], [3.0], [2.0]])
        weight = np.log(in_good / in_good.sum(0)) - np.log(in_bad / in_bad.sum(0))
        plus, minus = np.maximum(weight[0], 0), np.minimum(weight[1], 0)
        prior = float(np.log(share / (1 - share)))
        odds = prior + (v == 1) @ plus + (v == -1) @ minus
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return prior, list(zip(plus.tolist(), minus.tolist()))


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """Measures, ``base_failed``, ``quality`` (posterior probability of a good document) and ``kept`` of each row.

    Each whole text is measured once and the measures are stored; votes are counted over all documents as patterns
    (at most 3 to the number of rules), on which the accuracies are estimated.  A null, empty or blank text has no
    words, fails the base rule and is not kept.  Repeated rows count each.  Columns named like a result give way to
    it; an empty table gives an empty table."""
    measured = stored(measure(without(docs, "base_failed", "quality", "kept"), text_col, keep))
    cast = votes()
    counted = measured.groupBy(*[c.alias(f"v{i}") for i, c in enumerate(cast.values())]).count()
    prior, weights = estimate([(tuple(r)[:-1], r["count"]) for r in counted.collect()])
    log_odds = F.lit(prior)
    for vote, (plus, minus) in zip(cast.values(), weights):
        log_odds = log_odds + F.when(vote == 1, plus).when(vote == -1, minus).otherwise(0.0)
    failed = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    scored = measured.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-log_odds)))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
