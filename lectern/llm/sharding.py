"""Sharding by a Hilbert curve over quantised metadata, cut into equal runs.

Law ``rows``: shard sizes in rows differ by one at most.  Three dimensions (hash buckets of source and language,
log2 of the text's bytes) are quantised to 5 bits each; rows are ordered by (curve index, CRC-32 of the text,
doc_id, size), so equal texts with equal metadata are neighbours and files cover small boxes of the metadata space.

Only (doc_id, size, crc, curve index) is shuffled, never text.  The global rank needs no single-partition window:
rows are range-partitioned and sorted, each carries its partition and offset, and the few per-partition counts give
the partition starts.  Equal keys never straddle one huge partition because doc_id is part of the range key.

Defined cases: null text has size 1 and CRC 0; null source or lang is bucket 0; a null doc_id sorts first; repeated
rows each get their own slot; an empty table gives an empty result; other columns are ignored.

``write_shards`` cuts the runs into files, with the bounds of every dimension per shard; ``read_shards`` opens only the
shards whose bounds meet a request.  There, rows equal in curve index, CRC-32, doc_id and size share a shard, all columns
are kept whatever their names, and a null source or language can be asked for.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import cut, table

BITS = 5
SHARDS = 16


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of integer points, one row a point (axes to transposed form, then interleaved)."""
    x = coords.astype(np.int64).T.copy()
    dims = x.shape[0]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & p
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        flip = np.where((x[dims - 1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_index(*dims, bits: int = BITS):
    """Column: Hilbert index of already quantised integer columns."""

    @F.pandas_udf("long")
    def index(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([a, b, c]), bits))

    return index(*dims)


def bucket(col, bits: int = BITS):
    """Hash bucket of a category; null is bucket 0, others 1 and up."""
    return F.when(col.isNull(), F.lit(0)).otherwise(F.pmod(F.crc32(col.cast("string")), F.lit((1 << bits) - 1)) + 1).cast("int")


def _measures() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    log2 = F.least(F.floor(F.log2(size.cast("double"))), F.lit((1 << BITS) - 1)).cast("int")
    source, lang = bucket(F.col("source")), bucket(F.col("lang"))
    return {"source": source, "lang": lang, "size": size, "text_crc32": F.crc32(text).cast("long"), "curve": curve_index(source, lang, log2)}


def shard(docs: DataFrame, n_shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot for every row."""
    m = _measures()
    narrow = docs.select("doc_id", *(m[c].alias(c) for c in ("size", "text_crc32", "curve")))
    spark = docs.sparkSession
    keys = ["curve", "text_crc32", "doc_id", "size"]
    narrow = cut(narrow, "shard-keys")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = narrow.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    placed = cut(placed.withColumn("at", F.monotonically_increasing_id()), "shard-order")
    part = F.shiftright("at", 33)
    # One row per range partition: the bound is the partition count, not the data.
    counts = sorted((r["p"], r["n"]) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    starts_df = spark.createDataFrame(starts, "p long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = placed.withColumn("p", part).join(F.broadcast(starts_df), "p").withColumn("rank", rank)
    shard_no = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L").cast("int")
    ranked = ranked.withColumn("shard", shard_no)
    first = F.expr(f"(shard * {max(total, 1)}L + {n_shards - 1}L) div {n_shards}L")
    return ranked.withColumn("slot", (F.col("rank") - first).cast("long")).select("doc_id", "size", "text_crc32", "curve", "shard", "slot")


#: Stored beside the rows' own columns: the dimensions, by which files and row groups are skipped.
_DIMS = ("source", "lang", "size")
ANY = object()


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS) -> None:
    """Rows under ``path``/rows by shard, in the order of the curve; ``path``/bounds has a row per shard.

    The driver holds one key a shard.  A shard may be several files, each a run of the curve.
    """
    spark = docs.sparkSession
    firsts = shard(docs, n_shards).where("slot = 0").collect()
    keyed = docs.withColumns({f"__shard_{name}": c for name, c in _measures().items()})

    def key(curve, crc, doc_id, size):
        return F.struct(curve.cast("long"), crc.cast("long"), doc_id.isNotNull(), F.coalesce(doc_id.cast("long"), F.lit(0)), size.cast("long"))

    own = key(F.col("__shard_curve"), F.col("__shard_text_crc32"), F.col("doc_id"), F.col("__shard_size"))
    starts = [F.when(own >= key(*(F.lit(r[c]) for c in ("curve", "text_crc32", "doc_id", "size"))), F.lit(r["shard"])) for r in firsts]
    placed = keyed.withColumn("__shard", F.greatest(F.lit(0), F.lit(0), *starts))
    order = ["__shard", "__shard_curve", "__shard_text_crc32", "doc_id", "__shard_size"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("__shard_curve", "__shard_text_crc32")
    placed.write.partitionBy("__shard").parquet(f"{path}/rows")
    spark.createDataFrame([(placed.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{path}/schema")
    ends = [f(f"__shard_{d}").alias(f"{name}_{d}") for d in _DIMS for name, f in (("min", F.min), ("max", F.max))]
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    rows.groupBy(F.col("__shard").alias("shard")).agg(F.count("*").alias("n_rows"), *ends).coalesce(1).write.parquet(f"{path}/bounds")


def shards_for(spark: SparkSession, path: str, source=ANY, lang=ANY, least: int = 0, most: int | None = None) -> list[int]:
    """Shards that may hold rows of the source, language (None asks for null) and sizes ``least`` to ``most``."""
    bounds = spark.read.parquet(f"{path}/bounds").where(F.col("max_size") >= least)
    if most is not None:
        bounds = bounds.where(F.col("min_size") <= most)
    for name, value in (("source", source), ("lang", lang)):
        if value is not ANY:
            bounds = bounds.where(bucket(F.lit(value)).between(F.col(f"min_{name}"), F.col(f"max_{name}")))
    return sorted(r["shard"] for r in bounds.select("shard").collect())


def read_shards(spark: SparkSession, path: str, source=ANY, lang=ANY, least: int = 0, most: int | None = None) -> DataFrame:
    """The rows asked for, as ``shards_for`` has it; other shards aren't opened, and the dimensions reach the scan."""
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/schema").first()["schema"]))
    found = shards_for(spark, path, source, lang, least, most)
    rows = spark.read.schema(schema).parquet(f"{path}/rows").where(F.col("__shard").isin(found) & (F.col("__shard_size") >= least))
    if most is not None:
        rows = rows.where(F.col("__shard_size") <= most)
    for name, value in (("source", source), ("lang", lang)):
        if value is not ANY:
            rows = rows.where((F.col(f"__shard_{name}") == bucket(F.lit(value))) & F.col(name).cast("string").eqNullSafe(F.lit(value).cast("string")))
    return rows.drop("__shard", *(f"__shard_{d}" for d in _DIMS))


def op3_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
