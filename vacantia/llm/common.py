"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import zstandard

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure

# whole texts go to Python in batches of bounded size
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}

# for rows of megabytes: a reader holds a whole page and decodes a whole row group at once, and by default neither is closed before 100 rows
WIDE_ROWS = {"parquet.block.size": str(2 << 20), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}

# white space of the contracts: blank and U+0009 to U+000D, and nothing else
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def session(spark: SparkSession) -> SparkSession:
    """The session with the settings that the operators rely on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return configure(spark)


def shared_folder(spark: SparkSession) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir).

    Only where the setting is missing, as in tests on one machine, a temporary folder is made and set."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        root = context.getCheckpointDir()
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession)
    df.write.options(**(options or {})).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with a suffix where the table already has such a column (case does not matter)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        new = name
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without columns that an operator is about to add."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes: a key for equality that stays safe at trillions of rows."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of one byte per character take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def slices(texts: list, most: int = 1 << 20):
    """Runs of texts of about ``most`` characters each, to bound what one step holds; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text or "") > most:
            yield start, i
            start, size = i, 0
        size += len(text or "")
    if start < len(texts):
        yield start, len(texts)


def packed(numbers: list[np.ndarray], rest: bytes = b"", level: int = 3) -> bytes:
    """Lists of numbers below 2^32 and some bytes, compressed; numbers as four planes of bytes, of which high ones shrink to nothing."""
    sizes = np.array([len(numbers), *map(len, numbers)], "<u4").tobytes()
    planes = [n.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for n in numbers]
    return zstandard.compress(sizes + b"".join(planes) + rest, level)


def unpacked(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    """What ``packed`` took."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    at, out = 4 + 4 * n, []
    for size in np.frombuffer(raw, "<u4", n, 4).tolist():
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * size, at).reshape(4, size).T).view("<u4").ravel())
        at += 4 * size
    return out, raw[at:]


def summed(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of the given lengths."""
    ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    cuts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return ends[cuts[1:]] - ends[cuts[:-1]]
