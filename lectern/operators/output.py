"""Voices, names, tags and audio: what surrounds synthesis.  Engines are pluggable; the one here is a stand-in."""

from __future__ import annotations

import io
import unicodedata
import wave

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from lectern.functions import values as V

RATE = 24_000


def voices(spark: SparkSession) -> DataFrame:
    rows = [(i, *v) for i, v in enumerate(V.VOICES)]
    return spark.createDataFrame(rows, "pref int, id string, accent string, gender string, grade string")


def resolve_voices(asked: DataFrame) -> DataFrame:
    """(accent, gender[, voice]) with chosen, or an error that names the nearest accent; an explicit voice wins, unchecked."""
    table = voices(asked.sparkSession)
    asked = asked if "voice" in asked.columns else asked.withColumn("voice", F.lit(None).cast("string"))
    first = table.groupBy("accent", "gender").agg(F.min_by("id", "pref").alias("best"))
    near = F.create_map(*(F.lit(x) for kv in V.NEAREST.items() for x in kv))
    names = F.create_map(*(F.lit(x) for kv in V.ACCENTS.items() for x in kv))
    out = asked.join(F.broadcast(first), ["accent", "gender"], "left")
    missing = F.concat(F.lit("no "), F.coalesce(names[F.col("accent")], F.col("accent")), F.lit(" voice; nearest: "), F.coalesce(near[F.col("accent")], F.lit("us")))
    out = out.withColumn("chosen", F.coalesce("voice", "best")).withColumn("error", F.when(F.col("chosen").isNull(), missing))
    return out.drop("best")


@F.pandas_udf(StringType())
def _slug(text: pd.Series) -> pd.Series:
    import re

    def one(t):
        if t is None:
            return None
        ascii_ = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
        s = re.sub(r"[\s_-]+", "-", re.sub(r"[^\w\s-]", "", ascii_).strip().lower()).strip("-")
        return s if len(s) <= 80 else s[:80].rsplit("-", 1)[0] or s[:80]

    return text.map(one)


def slug(c):
    """File-name stem: ASCII, hyphens, at most 80 characters cut at a hyphen."""
    return _slug(c)


FALLBACK_STEM = "document"


def default_stem(title, path, url):
    """The first of title, file stem, and the url's last step or host that leaves a slug."""
    name = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]*)/*$", 1), r"(?<=.)\.[^.]*$", "")
    parts = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)", 2)
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    tail = F.when(name(parts) != "", name(parts)).otherwise(host)
    return F.coalesce(*(F.when(slug(c) != "", slug(c)) for c in (title, name(path), tail)), F.lit(FALLBACK_STEM))


#: Groups in which the rows of one stem are numbered, so that a stem many documents share is no single task.
NUMBER_GROUPS = 64


def unique_stems(df: DataFrame, stem: str, key: str) -> DataFrame:
    """``df`` with name: derived names never clash.

    Rows of a stem are ordered by (key modulo ``NUMBER_GROUPS``, key), ``key`` being an integer.  The first keeps the stem;
    the others get the free suffixes -2, -3 ... in turn, where a suffix is free if the stem with it is no stem itself.
    """
    rows = df.withColumn("__g", F.coalesce(F.pmod(F.col(key), F.lit(NUMBER_GROUPS)), F.lit(0)).cast("int"))
    part = Window.partitionBy(stem, "__g")
    before = Window.partitionBy("__stem").orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(F.col(stem).alias("__stem"), "__g").agg(F.count("*").alias("n"))
    starts = starts.select("__stem", F.col("__g").alias("__h"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    rows = rows.withColumn("__no", F.row_number().over(part.orderBy(key)))
    rows = rows.join(starts, rows[stem].eqNullSafe(F.col("__stem")) & (F.col("__g") == F.col("__h"))).withColumn("__r", F.col("__start") + F.col("__no") - 1)
    # The j-th taken suffix t of a stem lies before the r-th free one if t - 1 - j < r.
    pattern = r"^(.*)-([1-9][0-9]{0,8})$"
    taken = df.select(F.regexp_extract(stem, pattern, 1).alias("base"), F.regexp_extract(stem, pattern, 2).alias("t")).where("t <> '' and t <> '1'").distinct()
    taken = taken.withColumn("t", F.col("t").cast("long"))
    taken = taken.withColumn("at", F.col("t") - 1 - F.row_number().over(Window.partitionBy("base").orderBy("t")))
    taken = taken.groupBy("base").agg(F.sort_array(F.collect_list("at")).alias("__taken"))
    rows = rows.join(taken, rows[stem] == F.col("base"), "left")
    skipped = F.size(F.filter(F.coalesce("__taken", F.array().cast("array<bigint>")), lambda at: at < F.col("__r")))
    number = (F.col("__r") + 1 + skipped).cast("string")
    return rows.withColumn("name", F.when(F.col("__r") == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("-"), number))).select(*df.columns, "name")


def tags(title, author, url, path):
    """Metadata map without absent entries."""
    full = F.create_map(F.lit("album"), F.lit("lectern"), F.lit("title"), title, F.lit("artist"), author, F.lit("comment"), F.coalesce(url, path))
    return F.map_filter(full, lambda _, v: v.isNotNull())


def wav(frames: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(RATE)
        w.writeframes(frames)
    return out.getvalue()


def silence(ms: int) -> bytes:
    return wav(b"\0\0" * int(RATE * ms / 1000))


def stand_in(text: str) -> bytes:
    """A deterministic engine for tests: silence at 15.57 characters a second."""
    return silence(int(1000 * len(text) / 15.57))


#: Bytes of audio after which a task passes rows on.
BATCH_BYTES = 8_000_000
_PACKED = b"ZWAV"


def packed(audio: bytes) -> bytes:
    """Audio as it travels between tasks: compressed without loss, its length ahead."""
    return _PACKED + len(audio).to_bytes(8, "little") + pa.compress(audio, codec="zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    """The audio of ``packed``; anything else as it is."""
    if data[:4] != _PACKED:
        return data
    return pa.decompress(memoryview(data)[12:], int.from_bytes(data[4:12], "little"), codec="zstd", asbytes=True)


def synthesize(missing: DataFrame, engine=stand_in, pack: bool = False) -> DataFrame:
    """(key, text) -> (key, audio); once per distinct key, whatever the number of documents that use it.

    A task holds ``BATCH_BYTES`` of audio and one piece at most.  With ``pack`` the audio is as ``packed`` gives it.
    """

    def run(frames):
        for pdf in frames:
            keys, audio, held = [], [], 0
            for key, text in zip(pdf["key"], pdf["text"], strict=True):
                keys.append(key)
                audio.append(packed(engine(text)) if pack else engine(text))
                held += len(audio[-1])
                if held >= BATCH_BYTES:
                    yield pd.DataFrame({"key": keys, "audio": audio})
                    keys, audio, held = [], [], 0
            if keys:
                yield pd.DataFrame({"key": keys, "audio": audio})

    return missing.select("key", "text").mapInPandas(run, "key string, audio binary")
