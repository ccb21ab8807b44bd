"""Reading order and block kinds from page geometry: raw blocks (doc_id, page, idx, text, x0, y0, x1, y1, size, chars, width, height).

Decoding PDF bytes needs a library that isn't here; geometry is the input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions import values as V

BINS = 240


def gutters(raw: DataFrame) -> DataFrame:
    """doc_id, page, split: the middle of the widest free run of bins, where both sides carry text."""
    page = ["doc_id", "page"]
    side = raw.where("width > 0 and not (x0 < width / 2 and width / 2 < x1)")
    enough = side.groupBy(*page).agg(F.count("*").alias("k")).where("k >= 4").select(*page)
    side = side.join(enough, page, "left_semi")
    scale = BINS / F.col("width")
    lo, hi = F.greatest(F.lit(0), F.floor(F.col("x0") * scale)).cast("int"), F.least(F.lit(BINS - 1), F.floor(F.col("x1") * scale)).cast("int")
    taken = side.where(lo <= hi).select(*page, F.explode(F.sequence(lo, hi)).alias("bin")).distinct()
    band = enough.withColumn("bin", F.explode(F.sequence(F.lit(72), F.lit(168))))
    free = band.join(taken, [*page, "bin"], "left_anti")
    free = free.withColumn("isle", F.col("bin") - F.row_number().over(Window.partitionBy(*page).orderBy("bin")))
    gap = free.groupBy(*page, "isle").agg(F.min("bin").alias("a"), (F.max("bin") + 1).alias("b")).withColumn("w", F.col("b") - F.col("a"))
    best = gap.groupBy(*page).agg(F.max(F.struct("w", (-F.col("a")).alias("na"), "b")).alias("g")).where(F.col("g.w") / BINS >= 0.015)
    split = (F.col("g.b") - F.col("g.na")) / 2 / scale
    rows = raw.join(best, page).withColumn("split", split)
    left, right = F.col("x1") <= F.col("split"), F.col("x0") >= F.col("split")
    chars = lambda side: F.coalesce(F.sum(F.when(side, F.col("chars"))), F.lit(0))
    sums = rows.groupBy(*page, "split").agg(F.sum(left.cast("int")).alias("nl"), F.sum(right.cast("int")).alias("nr"), chars(left).alias("cl"), chars(right).alias("cr"))
    return sums.where("nl >= 2 and nr >= 2 and cl + cr > 0 and least(cl, cr) / (cl + cr) >= 0.2").select(*page, "split")


def reading_order(raw: DataFrame) -> DataFrame:
    """``raw`` with pos: by band between full-width blocks, left column before right; else top to bottom."""
    rows = raw.join(gutters(raw), ["doc_id", "page"], "left")
    spans = F.coalesce((F.col("x0") < F.col("split")) & (F.col("x1") > F.col("split")), F.lit(False))
    by_y = Window.partitionBy("doc_id", "page").orderBy("y0", "idx")
    rows = rows.withColumn("spans", spans).withColumn("band", F.sum(F.col("spans").cast("int")).over(by_y))
    lane = F.when(F.col("split").isNull() | F.col("spans"), 0).when(F.col("x1") <= F.col("split"), 1).otherwise(2)
    free = F.col("split").isNull()
    keys = [F.when(free, 0).otherwise(F.col("band")), lane, F.when(free, F.bround("y0", 1)).otherwise(F.col("y0")), F.when(free, F.col("x0")).otherwise(0.0), F.col("idx")]
    return rows.withColumn("pos", (F.row_number().over(Window.partitionBy("doc_id").orderBy("page", *keys)) - 1).cast("int"))


def body_sizes(raw: DataFrame) -> DataFrame:
    """doc_id, body: the size that carries most characters; of equals the first seen."""
    by = raw.groupBy("doc_id", "size").agg(F.sum("chars").alias("c"), F.min(F.struct("page", "idx")).alias("seen"))
    top = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("c"), "seen"))
    return by.withColumn("rn", top).where("rn = 1").select("doc_id", F.col("size").alias("body"))


def classify(raw: DataFrame) -> DataFrame:
    """kind and level by caption wording and size ratio."""
    rows = raw.join(body_sizes(raw), "doc_id")
    head = (F.col("body") > 0) & (F.col("size") >= F.col("body") * 1.12) & (T.words(F.col("text")) <= 25)
    caption, share = F.col("text").rlike(T.U + V.CAPTION), F.col("size") / F.col("body")
    level = F.when(caption | ~head, 0).when(share >= 1.6, 1).when(share >= 1.3, 2).otherwise(3)
    kind = F.when(caption, "caption").when(head, "heading").otherwise("paragraph")
    return rows.withColumn("kind", kind).withColumn("level", level).withColumn("position", F.col("y0") / F.col("height"))


def _merge(pdf: pd.DataFrame) -> pd.DataFrame:
    out: list[dict] = []
    for row in pdf.sort_values("pos").to_dict("records"):
        last = out[-1] if out else None
        close = last is not None and last["kind"] == row["kind"] == "heading" and (last["level"], last["page"]) == (row["level"], row["page"])
        if close and 0 <= row["position"] - last["position"] < 0.05 and not last["text"].rstrip().endswith((".", "!", "?", ":")):
            last["text"] = f"{last['text'].rstrip()} {row['text'].lstrip()}"
        else:
            out.append(row)
    return pd.DataFrame(out, columns=pdf.columns)


def merge_headings(blocks: DataFrame) -> DataFrame:
    """Headings set over several lines become one; only documents with two headings go to Python."""
    many = blocks.where("kind = 'heading'").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id")
    merged = blocks.join(many, "doc_id", "left_semi").groupBy("doc_id").applyInPandas(_merge, blocks.schema)
    return blocks.join(many, "doc_id", "left_anti").unionByName(merged)


def titles(blocks: DataFrame) -> DataFrame:
    """doc_id, title: the first qualifying heading of page 1."""
    clean = T.strip(T.re_sub(F.col("text"), T.U + r"\s+", " "))
    ok = blocks.withColumn("title", clean).where("page = 1 and kind = 'heading' and level <= 2 and position < 0.35").where(F.length("title").between(3, 200))
    return ok.groupBy("doc_id").agg(F.min_by("title", "pos").alias("title"))
