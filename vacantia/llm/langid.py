"""Language identification: family first, then one-versus-one linear support vector machines inside the family."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import without

# fixed values: families of closely related languages; a language not named here is a family of its own
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be bg mk sr hr bs sl sk cs pl",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz",
    "indo-aryan": "hi ur bn mr ne pa gu",
    "semitic": "ar he",
    "malayic": "id ms jv",
}
FAMILY = {language: family for family, languages in FAMILIES.items() for language in languages.split()}

UNKNOWN = "und"
BINS = 1 << 13
# bounds of the labelled sample that the machines are fitted on
PER_LANGUAGE, SAMPLE = 500, 4000
PART = 1 << 20

# bytes to letters: A-Z lower-cased, bytes of other scripts as they are, everything else a blank
FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def grams(text: str) -> np.ndarray | None:
    """Shares of hashed runs of one to three bytes of the whole text, as square roots; None without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    folded = FOLD[np.frombuffer(f" {text} ".encode(), np.uint8)]
    blank = folded == 32
    folded = folded[~np.concatenate([[False], blank[1:] & blank[:-1]])]
    counts = np.zeros(BINS, np.int64)
    for start in range(0, len(folded), PART):  # parts overlap by two bytes, so no run is lost
        b = folded[start:start + PART + 2].astype(np.uint32)
        n = min(PART, len(folded) - start)
        code = b
        for width in (1, 2, 3):
            if width > 1:
                code = code[:len(b) - width + 1] * np.uint32(0x01000193) + b[width - 1:] * np.uint32(0x9E3779B1)
            mixed = (code[:n] ^ (code[:n] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(width)
            counts += np.bincount(mixed >> np.uint32(19), minlength=BINS)
    return np.sqrt(counts / counts.sum())


def svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, c: float = 10.0, rounds: int = 15) -> np.ndarray:
    """Weights (the last is the bias) of a linear support vector machine, by dual coordinate descent.

    The two sides weigh alike, however many rows they have."""
    weights = np.zeros(BINS + 1)
    alpha = np.zeros(len(rows))
    norms = np.array([v @ v + 1 for _, v in rows])
    upper = np.where(sign > 0, c * len(sign) / (2 * max(1, (sign > 0).sum())), c * len(sign) / (2 * max(1, (sign < 0).sum())))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        for i in rng.permutation(len(rows)).tolist():
            at, v = rows[i]
            slack = sign[i] * (weights[at] @ v + weights[-1]) - 1
            new = min(max(alpha[i] - slack / norms[i], 0.0), upper[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                weights[at] += step * v
                weights[-1] += step
                alpha[i] = new
    return weights


class Model:
    """Families told apart one against the rest, languages of a family one against one."""

    def __init__(self, languages: list[str], rows: list[tuple[np.ndarray, np.ndarray]]):
        names = np.array(languages)
        self.languages = sorted(set(languages))
        family = np.array([FAMILY.get(x, x) for x in languages])
        self.families = sorted(set(family.tolist()))
        self.members = {f: [x for x in self.languages if FAMILY.get(x, x) == f] for f in self.families}
        heads = []
        if len(self.families) > 1:
            heads = [svm(rows, np.where(family == f, 1.0, -1.0)) for f in self.families]
        self.pairs = [p for f in self.families for p in combinations(self.members[f], 2)]
        for a, b in self.pairs:
            own = np.flatnonzero((names == a) | (names == b))
            heads.append(svm([rows[i] for i in own], np.where(names[own] == a, 1.0, -1.0)))
        self.weights = np.array(heads, np.float32).reshape(len(heads), BINS + 1)

    def predict(self, x: np.ndarray) -> list[tuple[str, float]]:
        """Language and score for rows of features; a score multiplies the shares of family and language."""
        margins = x @ self.weights[:, :-1].T + self.weights[:, -1] if len(self.weights) else np.zeros((len(x), 0))
        n = len(self.families) if len(self.families) > 1 else 0
        out = []
        for m in margins:
            share = _softmax(4 * m[:n]) if n else np.ones(1)
            best = int(share.argmax())
            members = self.members[self.families[best]]
            wins = dict.fromkeys(members, 0.0)
            for (a, b), d in zip(self.pairs, m[n:].tolist()):
                if a in wins:  # a vote for the winner; the margin parts equal votes
                    wins[a if d >= 0 else b] += 1
                    near = np.tanh(d) / len(members) ** 2
                    wins[a] += near
                    wins[b] -= near
            inner = _softmax(4 * np.array([wins[x] for x in members]))
            top = int(inner.argmax())
            out.append((members[top], float(min(1.0, share[best] * inner[top]))))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def _featured(batches):
    for batch in batches:
        keep, at, values = [], [], []
        for i, text in enumerate(batch.column(1)):
            found = grams(text.as_py())
            if found is not None:
                index = np.flatnonzero(found)
                keep.append(i)
                at.append(index.astype(np.int32).tobytes())
                values.append(found[index].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(at, pa.binary()), pa.array(values, pa.binary())],
                                         ["lang", "at", "value"])


def held_out(id_col: str) -> Column:
    """Documents that are never learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, sample: int = SAMPLE) -> Model | None:
    """Machines fitted on a bounded sample of labelled documents that are not held out; None if there are none.

    Of each label, the ``sample`` most frequent ones at most, up to ``per_language`` documents of smallest hashed id are
    taken, evenly fewer where that exceeds ``sample`` rows in all.  Whole texts become features in tasks; the driver gets
    the sparse features of the sample only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    rows = rows.filter(~held_out("id") & F.col("id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample).collect()
    if not common:
        return None
    each = max(1, min(per_language, sample // len(common)))
    ranked = Window.partitionBy("lang").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), "id")
    # about twice the rows wanted pass by their hash, so that ranking never meets a whole language
    shares = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 2 * each / r["count"]) * (1 << 30))) for r in common], "lang string, share long")
    chosen = rows.select("id", "lang").join(F.broadcast(shares), "lang")
    chosen = chosen.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("share")).select("id", "lang")
    chosen = chosen.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= each)
    chosen = F.broadcast(chosen.select("id", "lang").distinct())
    texts = rows.join(chosen, ["id", "lang"], "left_semi").groupBy("id", "lang").agg(F.min("text").alias("text"))
    found = texts.select("lang", "text").mapInArrow(_featured, "lang string, at binary, value binary")
    found = sorted(found.collect())
    if not found:
        return None
    return Model([r.lang for r in found], [(np.frombuffer(r["at"], np.int32), np.frombuffer(r.value, np.float32)) for r in found])


def _predicted(model: Model | None):
    def run(batches):
        for batch in batches:
            names, scores = [UNKNOWN] * len(batch), [0.0] * len(batch)
            rows, at = [], []

            def flush():
                for i, (name, score) in zip(at, model.predict(np.array(rows, np.float32))):
                    names[i], scores[i] = name, score
                rows.clear()
                at.clear()

            for i, text in enumerate(batch.column(0) if model else ()):
                found = grams(text.as_py())
                if found is not None:
                    rows.append(found)
                    at.append(i)
                if len(rows) == 64:
                    flush()
            if rows:
                flush()
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) with ``lang_pred`` and ``score`` (0 to 1) of each whole text.

    A null text, one without a letter, and every text where nothing was learned is ``und`` with score 0.  Only the
    text is looked at.  Columns named like a result give way to it; repeated rows are predicted alike."""
    kept = without(docs, "lang_pred", "score")
    names = [c for c in kept.columns if keep is None or c in keep]
    plain = [f"c{i}" for i in range(len(names))]
    rows = kept.select(F.col(text_col).alias("text"), *[F.col(f"`{c}`").alias(p) for c, p in zip(names, plain)])
    schema = "".join(f"{p} {rows.schema[p].dataType.simpleString()}, " for p in plain)
    found = rows.mapInArrow(_predicted(model), f"{schema}lang_pred string, score double")
    return found.withColumnsRenamed(dict(zip(plain, names)))
