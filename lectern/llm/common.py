"""What the corpus operators share: table access, cut points, word and hash conventions.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere.  On UTF-8 bytes that is exactly ``bytes.split()``,
because no byte of a multi-byte character lies in that class.
"""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

WORD_RE = r"[^\x20\x09-\x0D]+"
SPACE_RE = r"[\x20\x09-\x0D]+"
_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Few rows of the driver as a table; unlike ``createDataFrame`` of a list it starts no Python workers on the executors."""
    fields = StructType.fromDDL(schema)
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(cols, to_arrow_schema(fields), strict=True)], fields.names), fields)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a folder of its own only where it is unset and all tasks run in this process."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        _OWN_DIR[app] = tempfile.mkdtemp(prefix="lectern-shared-")
    return f"file://{_OWN_DIR[app]}"


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lectern-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back, so a lost executor costs a re-read."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(col):
    """Words of a text, null counting as none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD_RE)), F.lit(0)).cast("long")


def utf8(col):
    """UTF-8 bytes of a text, null counting as empty."""
    return F.coalesce(col, F.lit("")).cast("binary")


def unit_interval(*cols):
    """A reproducible number in (0, 1) from the hash of the given columns."""
    return (F.xxhash64(*cols).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def portions(batches, size: int = 4 << 20):
    """(rows, their UTF-8 texts) in portions of at most ``size`` bytes of text, or one row, so working memory is bounded."""
    for b in batches:
        texts = b["text"].cast(pa.binary())
        start = held = 0
        for i, t in enumerate(texts):
            n = len(t.as_buffer()) if t.is_valid else 0
            if held + n > size and i > start:
                yield b.slice(start, i - start), [x.as_py() or b"" for x in texts.slice(start, i - start)]
                start, held = i, 0
            held += n
        if start < b.num_rows:
            yield b.slice(start), [x.as_py() or b"" for x in texts.slice(start)]


def small_batches(spark: SparkSession, rows: int) -> None:
    """Lower the session's rows per Arrow batch to ``rows``, for good: a plan reads the setting when it runs.  It never changes results."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def trim() -> None:
    """Give memory back at the end of a task: idle workers are kept for the next one."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


class WordHashes(dict):
    """word -> 64-bit hash, remembered; forgets everything when it holds ``limit`` words, so memory is bounded."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def window_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` neighbours (64-bit arithmetic wraps)."""
    n = len(ids) - width + 1
    h = ids[:n].copy()
    for k in range(1, width):
        h *= _MUL
        h += ids[k : k + n]
    return mix64(h)


def shingle_set(text: bytes, memory: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; the whole sequence where it is shorter than ``width``."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    ids = memory.of(words)
    if len(words) < width:
        return window_hashes(np.concatenate([ids, np.full(1, len(words), np.uint64)]), len(words) + 1)
    return np.unique(window_hashes(ids, width))
