"""Driver tables as blocks.  (Pages of 20 lines are synthetic: they exercise the paged rules.)"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "doc_id long, pos int, kind string, text string, level int, ordinal int, page int, position double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows out by key if the files give fewer tasks than there are cores; larger inputs keep their splits."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def prose(spark: SparkSession, sf_dir: str, paged: bool = False) -> DataFrame:
    """One block a line of ``documents``; lines with two or more ' | ' are tables."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    kind = F.when(F.col("text").rlike(r" \| .* \| "), "table").otherwise("paragraph")
    page = F.floor(F.col("pos") / 20).cast("int") + 1 if paged else F.lit(None).cast("int")
    position = (F.col("pos") % 20) / 20.0 if paged else F.lit(None).cast("double")
    null = F.lit(None).cast("int")
    return lines.select("doc_id", "pos", kind.alias("kind"), "text", F.lit(0).alias("level"), null.alias("ordinal"), page.alias("page"), position.alias("position"))


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per conversation: each turn a heading with the role, then its text."""
    turns = spread(table(spark, sf_dir, "conversations"), "conv_id")
    both = F.array(F.struct(F.lit("heading").alias("kind"), F.col("role").alias("text"), F.lit(2).alias("level")), F.struct(F.lit("paragraph").alias("kind"), F.col("text").alias("text"), F.lit(0).alias("level")))
    rows = turns.select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(both).alias("i", "b"))
    null = F.lit(None).cast("int")
    return rows.select("doc_id", (F.col("turn") * 2 + F.col("i")).cast("int").alias("pos"), "b.kind", "b.text", "b.level", null.alias("ordinal"), null.alias("page"), F.lit(None).cast("double").alias("position"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, content of local HTML and PDF files; content beats the extension."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.lower(F.regexp_replace(F.decode(F.substring("content", 1, 2048), "ISO-8859-1"), r"^\s+", ""))
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    marks = head.rlike(r"^(<!doctype html|<html|<head|<body|<\?xml)") | head.contains("<html") | head.contains("<!doctype html")
    kind = F.when(head.startswith("%pdf-"), "pdf").when(marks, "html").when(ext.isin("html", "htm", "xhtml", "xht"), "html")
    error = F.when(kind.isNotNull(), None).when(ext == "pdf", "not a PDF file").otherwise("unsupported file type")
    return files.select("path", kind.alias("kind"), error.alias("error"), "content")
