"""Chunks that span pauses, what that costs, and evenly strided samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_sentences(text: Column, limit: int) -> Column:
    """Sentences filled greedily up to ``limit`` characters; a longer sentence stays whole."""
    last = lambda acc: F.element_at(acc, -1)
    empty = F.array().cast("array<string>")

    def add(acc, s):
        fits = (F.size(acc) > 0) & (F.length(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(""))) + F.length(s) + 1 <= limit)
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), s)))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.filter(F.split(text, "(?<=[.!?]) +", -1), lambda s: s != ""), empty, add)


def fill(runs: DataFrame, limit: int) -> DataFrame:
    """The runs with ``chunk``: neighbours share one while their texts, joined by a space, fit ``limit`` characters.

    Only run numbers and lengths are gathered by document, never texts.
    """
    ordered = F.array_sort(F.collect_list(F.struct("run_id", F.col("n_chars").cast("int").alias("n"))))
    start = F.struct(F.lit(-1).alias("chunk"), F.lit(limit).alias("used"), F.array().cast("array<struct<run_id:int,chunk:int>>").alias("out"))

    def add(acc, x):
        fits = (acc["chunk"] >= 0) & (acc["used"] + x["n"] + 1 <= limit)
        chunk = F.when(fits, acc["chunk"]).otherwise(acc["chunk"] + 1)
        used = F.when(fits, acc["used"] + x["n"] + 1).otherwise(x["n"])
        return F.struct(chunk.alias("chunk"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(x["run_id"].alias("run_id"), chunk.alias("chunk")))).alias("out"))

    placed = runs.groupBy("doc_id").agg(F.aggregate(ordered, start, add, lambda acc: acc["out"]).alias("o"))
    return runs.join(placed.select("doc_id", F.explode("o").alias("o")).select("doc_id", "o.run_id", "o.chunk"), ["doc_id", "run_id"])


def merged_chunks(runs: DataFrame, limit: int) -> DataFrame:
    """doc_id, chunk, part, text: filled chunks; one run over the limit is split by sentences into parts."""
    texts = F.array_sort(F.collect_list(F.struct("run_id", "text")))
    rows = fill(runs, limit).groupBy("doc_id", "chunk").agg(F.array_join(F.transform(texts, lambda x: x["text"]), " ").alias("text"))
    parts = F.when(F.length("text") > limit, split_sentences(F.col("text"), limit)).otherwise(F.array("text"))
    return rows.select("doc_id", "chunk", F.posexplode(parts).alias("part", "text"))


def merge_report(runs: DataFrame, limit: int) -> DataFrame:
    """doc_id, n_chunks, kept, lost: pauses between runs that stay at a chunk's edge, and those it speaks through."""
    rows = fill(runs, limit).groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("chunk").alias("n_chunks"))
    return rows.select("doc_id", "n_chunks", (F.col("n_chunks") - 1).alias("kept"), (F.col("n") - F.col("n_chunks")).alias("lost"))


def evenly(rows: DataFrame, n: int, key: str = "doc_id", order: str = "run_id") -> DataFrame:
    """``n`` rows a key at even strides of the order; all where there are no more."""
    w = Window.partitionBy(key)
    ranked = rows.withColumns({"__k": F.row_number().over(w.orderBy(order)) - 1, "__of": F.count("*").over(w)})
    # Row k is taken if some i < n has floor(i * of / n) = k.
    i = F.ceil(F.col("__k") * n / F.col("__of"))
    return ranked.where((F.col("__of") <= n) | ((i < n) & (F.floor(i * F.col("__of") / n) == F.col("__k")))).drop("__k", "__of")
