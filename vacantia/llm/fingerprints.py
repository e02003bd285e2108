"""Document fingerprints that add up: a multiset hash of a document's paragraphs, in built-in functions only.

Every paragraph is hashed to a wide vector of +1 and -1, one entry per bit of its SHA-256, and a document's fingerprint
is the sum of the vectors, each lane modulo 2^16.  So the order of paragraphs does not matter, a paragraph that comes
or goes is added or taken away without the rest of the text, and, as vectors of different paragraphs are nearly at
right angles, the inner product of two fingerprints tells how much their documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import fresh

# lanes of a fingerprint, the power of two that they wrap at, and code points beyond which a paragraph is cut
LANES, BITS, PIECE = 128, 16, 256
# a paragraph ends with its line, or with a sentence of it
ENDS = (". ", "! ", "? ", "。")
# ids looked at to find cut points of the order, for each range
SAMPLE = 32


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text (null: one empty paragraph): sentences of lines, those over PIECE code points in runs of PIECE."""
    text = F.coalesce(text, F.lit(""))
    for end in ENDS:
        text = F.replace(text, F.lit(end), F.lit(end + "\n"))
    pieces = F.split(text, "\n", -1)
    runs = lambda p: F.regexp_extract_all(p, F.lit("(?s).{1,%d}" % PIECE), 0)
    long = F.exists(pieces, lambda p: F.length(p) > PIECE)
    return F.when(long, F.flatten(F.transform(pieces, lambda p: F.when(F.length(p) > PIECE, runs(p)).otherwise(F.array(p))))).otherwise(pieces)


def fingerprint(pieces: Column) -> Column:
    """The sum of the vectors of an array of paragraphs: LANES whole numbers from 0 to 2^BITS - 1; an empty array gives zeros.

    Lane 32 k + s belongs to bit s of the hash's k-th group of eight digits.  Two groups are counted at a time, in the
    halves of one number: a half holds the count of any array that Spark can hold."""
    def word(digest, k):
        half = lambda i: F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint")
        return F.shiftleft(half(2 * k), 32).bitwiseOR(half(2 * k + 1))

    def counts(words, name):
        return F.transform(F.sequence(F.lit(0), F.lit(31)), lambda s: F.aggregate(
            words, F.lit(0).cast("bigint"), lambda total, w: total + F.call_function("shiftrightunsigned", w[name], s).bitwiseAND((1 << 32) | 1)))

    def lanes(words):
        n = F.size(words)
        lane = lambda c: F.pmod(2 * c - n, F.lit(1 << BITS)).cast("int")
        high = lambda c: F.transform(c, lambda x: lane(F.shiftrightunsigned(x, 32)))
        low = lambda c: F.transform(c, lambda x: lane(x.bitwiseAND((1 << 32) - 1)))
        both = [_bound(counts(words, name), lambda c: F.concat(high(c), low(c))) for name in ("a", "b")]
        return F.concat(*both)

    hashed = F.transform(pieces, lambda p: _bound(F.sha2(p, 256), lambda d: F.struct(word(d, 0).alias("a"), word(d, 1).alias("b"))))
    return _bound(hashed, lanes)


def added(a: Column, b: Column) -> Column:
    """The fingerprint of two multisets of paragraphs together: what comes in is added without the rest of the text."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(1 << BITS)))


def removed(a: Column, b: Column) -> Column:
    """The fingerprint of ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(1 << BITS)))


def spelled(lanes: Column) -> Column:
    """Four lowercase hex digits a lane."""
    return F.lower(F.array_join(F.transform(lanes, lambda x: F.lpad(F.hex(x), BITS // 4, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """How much two fingerprints share, 0 to 1: 2ab / (aa + bb) of their lanes, read as signed numbers.

    Estimates the same ratio over the counts of paragraphs, within about 1 / sqrt(LANES); equal fingerprints give 1."""
    signed = lambda x: F.when(x >= 1 << (BITS - 1), x - (1 << BITS)).otherwise(x).cast("bigint")
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda s, x: s + x)
    inner = total(F.zip_with(a, b, lambda x, y: signed(x) * signed(y)))
    norms = total(F.zip_with(a, b, lambda x, y: signed(x) * signed(x) + signed(y) * signed(y)))
    return F.when(a == b, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * inner / F.when(norms > 0, norms))))


def _cuts(docs: DataFrame, key: str, ranges: int) -> list:
    """Ids that part the table in about equal ranges, from those with the smallest hashes: at most SAMPLE a range reach the driver."""
    ids = docs.filter(F.col(key).isNotNull()).select(key).distinct().orderBy(F.xxhash64(key), key).limit(SAMPLE * ranges)
    found = sorted(r[0] for r in ids.collect())
    return sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []


def _range(key: Column, cuts: list) -> Column:
    """How many cuts are not above the key, by binary search; 0 for null."""
    if not cuts:
        return F.lit(0)
    bounds, steps = F.array(*map(F.lit, cuts)), [1 << i for i in reversed(range(len(cuts).bit_length()))]
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when(
        F.coalesce(F.try_element_at(bounds, at + s) <= key, F.lit(False)), at + s).otherwise(at))
    return F.when(key.isNull(), 0).otherwise(place)


def with_next(docs: DataFrame, columns: list[str], id_col: str = "doc_id", ranges: int | None = None) -> DataFrame:
    """Each row with the ``columns`` of the next one as ``next_<name>``, by ascending id; after the last comes the first.

    Null ids stand first, rows of one id are ordered by a hash of the columns.  Ids are cut into ranges; each row goes
    to the task of its range, and the first id of a range also to that of the range before, so rows move once and no
    task sees more than its range.  Rows of one id share a range, so ids should be unique or nearly so."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(docs, id_col, ranges or 4 * parts)
    at, guest, tie = fresh(docs, "range", "guest", "tie")
    placed = docs.withColumn(at, _range(F.col(id_col), cuts))
    # nulls come first, so a range's first key is null where it holds one
    firsts = sorted((r[0], None if r[2] else r[1]) for r in
                    placed.groupBy(at).agg(F.min(id_col), F.max(F.col(id_col).isNull())).collect())
    before = [F.when((F.col(at) == here) & F.col(id_col).eqNullSafe(F.lit(first)), firsts[i - 1][0]) for i, (here, first) in enumerate(firsts)]
    homes = F.array(F.col(at), F.coalesce(*before)) if before else F.array(F.col(at), F.lit(None).cast("int"))
    rows = placed.select("*", F.posexplode(F.array_compact(homes)).alias(guest, at + "_")).drop(at)
    order = Window.partitionBy(at + "_").orderBy(guest, F.col(id_col).asc_nulls_first(), tie)
    rows = rows.withColumn(tie, F.xxhash64(*columns))
    return rows.select("*", *[F.lead(c).over(order).alias("next_" + c) for c in columns]).filter(F.col(guest) == 0).drop(at + "_", guest, tie)


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``text``, ``lanes`` of every whole text (null: empty), and the same of its edited text and of the next document.

    The edited text has the last quarter of its code points replaced by as many first ones of the next document
    (``with_next``), or all where that is shorter; a single row is its own next one.  Repeated rows stay, other columns are not returned,
    an empty table gives an empty one."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("lanes", fingerprint(paragraphs(F.col("text")))), ["text", "lanes"], id_col)
    gone = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.left("text", F.length("text") - gone), F.left("next_text", gone))
    rows = rows.withColumn("edited_text", edited)
    return rows.withColumn("edited_lanes", fingerprint(paragraphs(F.col("edited_text"))))
