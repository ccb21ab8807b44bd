"""Rules 1 to 9 on blocks (doc_id, pos, kind, text, level, ordinal, page, position).

Everything is keyed by doc_id; order is the explicit pos.  Filters and projections fuse into the scan; the few joins
carry keys, not texts.
"""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions import text as T
from lectern.functions import values as V


def hygiene(blocks: DataFrame) -> DataFrame:
    """Rule 1, then blank blocks go."""
    text = F.col("text")
    # No rule takes a letter or digit away: where there is one, the filter need not repair the text to know.
    return blocks.where(text.rlike("[A-Za-z0-9]") | (T.repair_unicode(text) != "")).withColumn("text", T.repair_unicode(text))


def drop_running(blocks: DataFrame) -> DataFrame:
    """Rule 2: short blocks that repeat on three pages, or on two and always at an edge."""
    key = T.re_sub(F.lower(T.strip(T.re_sub(F.col("text"), T.U + r"\s+", " "))), T.U + r"\d+", "#")
    keyed = blocks.withColumn("rkey", F.when(F.col("page").isNotNull() & (T.words(F.col("text")) <= 12), key))
    edge = F.coalesce((F.col("position") < 0.12) | (F.col("position") > 0.88), F.lit(False))
    group = Window.partitionBy("doc_id", "rkey")
    pages, edges = F.size(F.collect_set("page").over(group)), F.min(edge.cast("int")).over(group)
    doomed = F.coalesce(F.col("rkey") != "", F.lit(False)) & ((pages >= 3) | ((pages >= 2) & (edges == 1)))
    return keyed.withColumn("__doomed", doomed).where("not __doomed").select(*blocks.columns)


def drop_stamps(blocks: DataFrame) -> DataFrame:
    """Rule 2b."""
    stamp = F.col("page").isNotNull() & (T.words(F.col("text")) <= 20) & F.col("text").rlike(T.U + V.STAMP)
    return blocks.where(~stamp)


def drop_page_numbers(blocks: DataFrame) -> DataFrame:
    """Rule 3."""
    edge = F.coalesce((F.col("position") < 0.15) | (F.col("position") > 0.85), F.lit(False))
    return blocks.where(~(edge & T.strip(F.col("text")).rlike(T.U + V.PAGE_NUMBER)))


_MARKS = r"""[.,;:!?()\[\]"']+"""
OUTER_MARKS = f"^{_MARKS}|{_MARKS}$"


def vocabulary(blocks: DataFrame) -> DataFrame:
    """doc_id, word: distinct lower-cased words without outer punctuation."""
    word = F.explode(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)))
    words = blocks.select("doc_id", word.alias("word"))
    return words.select("doc_id", F.lower(T.re_sub("word", OUTER_MARKS, "")).alias("word")).where("word <> ''").distinct()


def repair_wraps(blocks: DataFrame) -> DataFrame:
    """Rules 4 and 5.  Only hyphenated words that a break splits anywhere are looked up, never whole vocabularies."""
    pattern = T.U + r"(\w+)-\n(\w+)"
    left, right = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (1, 2))
    joined = F.zip_with(left, right, lambda a, b: F.concat(F.lower(a), F.lit("-"), F.lower(b)))
    doc = Window.partitionBy("doc_id")
    broken = F.col("text").contains("-\n")
    out = blocks.withColumn("__asked", F.array_distinct(F.flatten(F.collect_list(F.when(broken, joined)).over(doc))))
    # Words are taken apart only in documents that have a broken one.
    said = F.transform(F.regexp_extract_all("text", F.lit(T.WORD), F.lit(0)), lambda w: F.lower(T.re_sub(w, OUTER_MARKS, "")))
    held = F.when(F.size("__asked") > 0, F.array_intersect("__asked", said))
    out = out.withColumn("known", F.flatten(F.collect_list(held).over(doc)))
    has = F.coalesce(F.col("known"), F.array().cast("array<string>"))
    glued = F.zip_with(left, right, lambda a, b: F.concat(a, F.when(F.array_contains(has, F.concat(F.lower(a), F.lit("-"), F.lower(b))), F.lit("-")).otherwise(F.lit("")), b))
    parts = F.zip_with(F.split("text", pattern, -1), glued, lambda p, g: F.concat(p, F.coalesce(g, F.lit(""))))
    fixed = F.when(F.col("text").contains("-\n"), F.array_join(parts, "")).otherwise(F.col("text"))
    return out.withColumn("text", T.join_wraps(fixed)).select(*blocks.columns)


def drop_boilerplate(blocks: DataFrame) -> DataFrame:
    """Rule 6."""
    return blocks.where(~T.is_boilerplate(F.col("text")))


def _measured(blocks: DataFrame) -> DataFrame:
    words = T.tokens(F.col("text"))
    short = (F.col("kind") == "paragraph") & (T.words(F.col("text")) <= 40)
    return blocks.select("doc_id", "pos", "text", words.alias("tok"), (F.col("kind").isin("quote", "caption") | short).alias("can")).withColumn("n", F.size("tok")).where("n > 0")


def contained(blocks: DataFrame) -> DataFrame:
    """doc_id, pos of candidates whose tokens are a run inside a strictly longer block of the same document.

    Candidates meet only blocks that hold their rarest bigram (or their one token): that found in the fewest blocks of the
    document.  Bigrams of other blocks that no candidate has are never rows of the join.
    """
    m = _measured(blocks)
    padded = F.concat(F.lit(" "), F.array_join("tok", " "), F.lit(" "))
    m = m.select("doc_id", "pos", "n", "can", "tok", padded.alias("run"))
    grams = F.array_distinct(F.when(F.col("n") > 1, F.zip_with(F.slice("tok", 1, F.col("n") - 1), F.slice("tok", 2, F.col("n") - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>")))
    needle = m.where("can")
    # Of each bigram of a document: its blocks, the longest of them, the candidates among them.
    held = m.where("n > 1").select("doc_id", "pos", "n", "can", F.explode(grams).alias("g"))
    gram = Window.partitionBy("doc_id", "g")
    held = held.withColumns({"df": F.count("*").over(gram), "most": F.max("n").over(gram), "asked": F.max("can").over(gram)})
    held = held.where("asked and df > 1")
    anchor = held.where("can").groupBy("doc_id", "pos", "n").agg(F.count("*").alias("k"), F.min(F.struct("df", "g", "most")).alias("x"))
    # Every distinct bigram of a contained run lies in the longer block too, so none of a candidate's may be missing.
    size = needle.where("n > 1").select("doc_id", "pos", F.size(grams).alias("k"))
    two = anchor.join(size, ["doc_id", "pos", "k"]).where("x.most > n").select("doc_id", "pos", "n", F.col("x.g").alias("g"))
    hay = held.select("doc_id", F.col("pos").alias("hpos"), F.col("n").alias("hn"), "g")
    met = two.join(hay, ["doc_id", "g"]).where("hn > n").select("doc_id", "pos", "hpos")
    met = met.join(m.select("doc_id", "pos", "run"), ["doc_id", "pos"])
    hits = met.join(m.select("doc_id", F.col("pos").alias("hpos"), F.col("run").alias("hrun")), ["doc_id", "hpos"]).where("instr(hrun, run) > 0").select("doc_id", "pos")
    words = m.where("n > 1").select("doc_id", F.explode(F.array_distinct("tok")).alias("w")).distinct()
    one = needle.where("n = 1").withColumn("w", F.get("tok", F.lit(0))).join(words, ["doc_id", "w"], "left_semi").select("doc_id", "pos")
    return hits.unionByName(one).distinct()


def ratio(a: list[str], b: list[str]) -> float:
    return SequenceMatcher(None, a, b).ratio()


def _may_resemble(n: int, bag: Counter, m: int, other: Counter) -> bool:
    """False only where the ratio is under 0.85 whatever the order: twice the shared tokens bound it."""
    return 0.739 * m <= n <= 0.95 * m and 2 * (bag & other).total() >= 0.85 * (n + m)


def duplicates(rows: list[tuple[int, bool, list[str]]]) -> set[int]:
    """Positions of one document that go, in greedy order: a candidate goes if a longer block that is still there holds or resembles it."""
    toks = [(pos, can, t, f" {' '.join(t)} ", Counter(t)) for pos, can, t in sorted(rows, key=lambda r: r[0])]
    longest, gone = sorted(toks, key=lambda r: -len(r[2])), set()
    for pos, can, t, run, bag in toks:
        if not can:
            continue
        for p, _, other, hay, whole in longest:
            if len(other) <= len(t):
                break
            if p not in gone and (run in hay or (_may_resemble(len(t), bag, len(other), whole) and ratio(t, other) >= 0.85)):
                gone.add(pos)
                break
    return gone


def drop_duplicates(blocks: DataFrame) -> DataFrame:
    """Rule 7, one pass over each document's blocks (containment alone is ``contained``): only documents with a candidate and a longer block go to Python."""
    words = T.tokens(F.col("text"))
    short = (F.col("kind") == "paragraph") & (T.words(F.col("text")) <= 40)
    can = (F.col("kind").isin("quote", "caption") | short) & (F.size(words) > 0)
    doc = Window.partitionBy("doc_id")
    rows = blocks.withColumn("__tok", words).withColumn("__can", can)
    least, most = F.min(F.when(F.col("__can"), F.size("__tok"))).over(doc), F.max(F.size("__tok")).over(doc)
    rows = rows.withColumn("__ask", F.coalesce(least < most, F.lit(False)))
    member = F.when(F.col("__ask") & (F.size("__tok") > 0), F.struct("pos", F.col("__can").alias("can"), F.col("__tok").alias("tok")))
    first = F.row_number().over(doc.orderBy("pos")) == 1
    # The list of a document goes to Python once, with its first block; the answer comes back by the same partitioning.
    rows = rows.withColumn("__all", F.collect_list(member).over(doc)).withColumn("__first", first)

    @F.pandas_udf("array<int>")
    def going(lists: pd.Series) -> pd.Series:
        return lists.map(lambda rows: sorted(duplicates([(r["pos"], r["can"], list(r["tok"])) for r in rows])))

    none = F.array().cast("array<struct<pos:int,can:boolean,tok:array<string>>>")
    rows = rows.withColumn("__gone", going(F.when(F.col("__first"), F.col("__all")).otherwise(none)))
    rows = rows.withColumn("__gone", F.flatten(F.collect_list("__gone").over(doc)))
    return rows.where(~F.array_contains("__gone", F.col("pos").cast("int"))).select(*blocks.columns)


def kind_policy(blocks: DataFrame, keep_captions: bool = False) -> DataFrame:
    """Rule 8: captions go; a run of tables and code becomes one announcement, labelled by its first."""
    kept = blocks if keep_captions else blocks.where("kind <> 'caption'")
    seq = Window.partitionBy("doc_id").orderBy("pos")
    omit = F.col("kind").isin("table", "code")
    before = F.coalesce(F.lag(omit).over(seq), F.lit(False))
    kept = kept.withColumn("omit", omit).withColumn("again", omit & before).where("not again")
    label = F.when(F.col("kind") == "table", "Table omitted.").otherwise("Code omitted.")
    kept = kept.withColumn("text", F.when(F.col("omit"), label).otherwise(F.col("text"))).withColumn("kind", F.when(F.col("omit"), "paragraph").otherwise(F.col("kind")))
    return kept.select(*blocks.columns)


def strip_citations(blocks: DataFrame, author_year: bool = False) -> DataFrame:
    """Rule 9, then blank blocks go."""
    return blocks.withColumn("text", T.strip_citations(F.col("text"), author_year)).where("text <> ''")


def normalise(blocks: DataFrame, keep_captions: bool = False, author_year: bool = False) -> DataFrame:
    """Rules 1 to 9 in order."""
    for rule in (hygiene, drop_running, drop_stamps, drop_page_numbers, repair_wraps, drop_boilerplate, drop_duplicates):
        blocks = blocks.transform(rule)
    return strip_citations(kind_policy(blocks, keep_captions), author_year)
