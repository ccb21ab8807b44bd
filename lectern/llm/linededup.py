"""Line dedup: repeated runs of lines over the whole corpus; later copies are deleted.

The corpus is a sequence of lines (those without a word are skipped), named by hash.  Prefix doubling names the runs of
1, 2, 4, ... lines that start, and that end, at each line: the name of 2k lines is the hash of the names of their
halves, so equal names are one bucket of the suffix array at that depth.  Any run of length n has the name
(n, name of its first 2^k lines, name of its last 2^k lines), 2^k the largest power in n: suffixes that share it are a
longest-common-prefix interval of depth n or more, and its smallest position is the first copy.

A run counts from ``min_words`` words.  For each line the shortest such runs that start and that end at it are looked
up; they are enough: every line of a longer repeated run lies in one of them, inside that run.  So a line is deleted
exactly if it lies in a run of ``min_words`` words or more that also occurs at an earlier place, by (doc_id, text hash,
line), overlaps included.  Since each line has a word, these runs have at most ``min_words`` lines, and doubling stops at
that depth.  All its levels run in one shuffle by document, with no join; a line or run that a third of the documents
share meets in counts before its shuffle, and its join back can be split.

Built-in functions only.  Defined cases: null text stays null; blank lines inside a deleted run go with it, others stay;
a text whose lines all go is empty; rows equal in (doc_id, text) are one document, and treated alike; a null doc_id
comes first; an empty table gives an empty result; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import cut, n_words, table

MIN_WORDS = 50


def runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, s, e (line numbers), n (lines), head, tail: the shortest runs of ``min_words`` words from and to each line."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("j", "line"))
    lines = lines.select("doc_id", "th", "j", F.xxhash64("line").alias("h"), n_words(F.col("line")).alias("w")).where("w > 0")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = lines.repartition(parts, "doc_id", "th").groupBy("doc_id", "th", "j").agg(F.first("h").alias("h"), F.first("w").alias("w"))
    doc = Window.partitionBy("doc_id", "th")
    seq = doc.orderBy("j")
    df = lines.withColumns({"rn": F.row_number().over(seq), "upto": F.sum("w").over(seq), "c0": F.col("h"), "b0": F.col("h")})
    depth = min_words.bit_length() - 1
    for k in range(1, depth + 1):
        step = 1 << (k - 1)
        df = df.withColumns({"ahead": F.lead(f"c{k - 1}", step).over(seq), "behind": F.lag(f"b{k - 1}", step).over(seq)})
        df = df.withColumns(
            {
                f"c{k}": F.when(F.col("ahead").isNotNull(), F.xxhash64(f"c{k - 1}", "ahead")),
                f"b{k}": F.when(F.col("behind").isNotNull(), F.xxhash64("behind", f"b{k - 1}")),
            }
        )
    names = {p: F.array(*(f"{p}{k}" for k in range(depth + 1))) for p in "cb"}
    df = df.select("doc_id", "th", "j", "rn", "w", "upto", (F.col("w") - F.col("upto")).alias("minus"), names["c"].alias("c"), names["b"].alias("b"))
    df = df.withColumns({"pj": F.lag("j").over(seq), "pb": F.lag("b").over(seq), "nj": F.lead("j").over(seq), "nc": F.lead("c").over(seq)})
    # Frames that only grow: each partition is walked once.
    to_end = doc.orderBy("minus").rangeBetween(Window.unboundedPreceding, -min_words)
    to_start = doc.orderBy("upto").rangeBetween(Window.unboundedPreceding, -min_words)
    df = df.withColumn("after", F.min(F.struct("rn", "pj", "pb")).over(to_end))
    df = df.withColumn("before", F.max(F.struct("rn", "nj", "nc")).over(to_start))
    df = df.withColumns({"last": F.max(F.struct("rn", "j", "b", "upto")).over(doc), "first": F.min(F.struct("rn", "j", "c")).over(doc)})

    def run(s, e, n, head, tail):
        level = F.floor(F.log2(n.cast("double"))).cast("int")
        return F.struct(s.alias("s"), e.alias("e"), n.alias("n"), F.get(head, level).alias("head"), F.get(tail, level).alias("tail"))

    c = F.col
    found, reaches = c("after").isNotNull(), c("last.upto") + c("minus") >= min_words
    from_here = F.when(
        found | reaches,
        run(
            c("j"), F.when(found, c("after.pj")).otherwise(c("last.j")), F.when(found, c("after.rn") - c("rn")).otherwise(c("last.rn") - c("rn") + 1),
            c("c"), F.when(found, c("after.pb")).otherwise(c("last.b")),
        ),
    )
    opened = c("before").isNotNull()
    to_here = F.when(
        (c("w") < min_words) & (opened | (c("upto") >= min_words)),
        run(
            F.when(opened, c("before.nj")).otherwise(c("first.j")), c("j"), F.when(opened, c("rn") - c("before.rn")).otherwise(c("rn") - c("first.rn") + 1),
            F.when(opened, c("before.nc")).otherwise(c("first.c")), c("b"),
        ),
    )
    both = F.filter(F.array(from_here, to_here), lambda x: x.isNotNull())
    return df.select("doc_id", "th", F.explode(both).alias("r")).select("doc_id", "th", "r.*")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, gone: the line numbers to delete, per document that has any."""
    found = cut(runs(docs, min_words), "line-runs")
    key = ["n", "head", "tail"]
    place = F.struct("doc_id", "th", "s")
    firsts = found.groupBy(*key).agg(F.min(place).alias("origin"), F.count("*").alias("copies")).where("copies > 1").select(*key, "origin")
    later = found.join(firsts, key).where(place > F.col("origin"))
    # Overlapping runs become one stretch first, so a document's array never holds a line twice.
    seq = Window.partitionBy("doc_id", "th").orderBy("s", "e")
    reach = F.max("e").over(seq.rowsBetween(Window.unboundedPreceding, -1))
    opens = later.select("doc_id", "th", "s", "e", F.when(F.col("s") <= reach, 0).otherwise(1).alias("opens"))
    stretch = opens.withColumn("stretch", F.sum("opens").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    stretch = stretch.groupBy("doc_id", "th", "stretch").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    gone = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("s", "e"))), lambda x: F.sequence(x["s"], x["e"])))
    return stretch.groupBy("doc_id", "th").agg(gone.alias("gone"))


def delete_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with text as left, plus __line_n (lines before) and __line_gone (line numbers deleted)."""
    gone = later_copies(docs, min_words).select(F.col("doc_id").alias("__line_id"), F.col("th").alias("__line_th"), F.col("gone").alias("__line_gone"))
    keyed = docs.withColumn("__line_key", F.xxhash64("text"))
    joined = keyed.join(gone, F.col("doc_id").eqNullSafe(F.col("__line_id")) & (F.col("__line_key") == F.col("__line_th")), "left")
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__line_gone"))
    left = F.when(F.col("__line_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    out = joined.withColumn("__line_n", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines))).withColumn("text", left)
    return out.drop("__line_id", "__line_th", "__line_key")


def op5_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = delete_lines(table(spark, sf_dir, "documents"))
    gone = F.coalesce(F.col("__line_gone"), F.array().cast("array<int>"))
    return out.select("doc_id", F.col("__line_n").cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_deleted"), F.array_join(gone, ",").alias("deleted"), F.coalesce("text", F.lit("")).alias("text"))


ORACLE_SQL = rf"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS j FROM split),
worded AS (SELECT doc_id, j, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM raw),
seq AS (SELECT *, row_number() OVER p AS rn, sum(w) OVER p AS upto FROM worded WHERE w > 0 WINDOW p AS (PARTITION BY doc_id ORDER BY j)),
docs AS (SELECT doc_id, list(line ORDER BY rn) AS ls FROM seq GROUP BY doc_id),
pairs AS (SELECT a.doc_id, a.j AS s, b.j AS e, a.rn AS sr, b.rn AS er FROM seq a JOIN seq b ON a.doc_id = b.doc_id AND b.rn BETWEEN a.rn AND a.rn + {MIN_WORDS}
  WHERE b.upto - a.upto + a.w >= {MIN_WORDS} AND (b.upto - b.w - a.upto + a.w < {MIN_WORDS} OR b.upto - a.upto < {MIN_WORDS})),
keyed AS (SELECT p.doc_id, s, e, ls[sr:er] AS k FROM pairs p JOIN docs USING (doc_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS place FROM keyed),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS j FROM ranked WHERE place > 1),
marked AS (SELECT r.doc_id, r.j, r.line, g.j IS NOT NULL AS del FROM raw r LEFT JOIN gone g ON r.doc_id = g.doc_id AND r.j = g.j)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE del)::BIGINT AS n_deleted,
  coalesce(string_agg(j::VARCHAR, ',' ORDER BY j) FILTER (WHERE del), '') AS deleted,
  coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (WHERE NOT del), '') AS text
FROM marked GROUP BY doc_id
"""
